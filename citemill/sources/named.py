"""Files under their own names: a sink that writes one file for each row (name, value).

    results.write.format("named_files").option("path", folder).mode("append").save()

A task writes its files to a folder of its own attempt below the target and hands their names to the driver. Only what successful
attempts hand over is moved into place, by the commit; what lost attempts left goes with the folder of the job. So a name stands for
the content of exactly one row, whatever failed on the way, and nothing is seen before the job has ended. The folder may be a path or
an address that pyarrow's file systems know; all machines must see it.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "named_files"


def _opened(path: str):
    """The file system and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), posixpath.abspath(path))


def checked(name: str | None) -> str:
    """A name that stays below the folder."""
    parts = (name or "").split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") or p.startswith(".job-") for p in parts) or "\x00" in name:
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    """The folder of an attempt, and the names of its files."""

    folder: str
    names: list[str]


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, f".job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, root = _opened(self.path)
        folder, names = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        for i, row in enumerate(iterator):
            name = checked(row.name)
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{i}") as out:
                out.write((row.value or "").encode())
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = _opened(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one name")
        if not self.overwrite and (there := [f.path for f in system.get_file_info([f"{root}/{n}" for n in names]) if f.type != fs.FileType.NotFound]):
            self.abort(messages)
            raise ValueError(f"there is a file already: {there[0]}")
        system.create_dir(root, recursive=True)
        for m in done:
            for i, name in enumerate(m.names):
                if "/" in name:
                    system.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                system.move(f"{m.folder}/{i}", f"{root}/{name}")
        self._cleared(system, root)

    def abort(self, messages: list) -> None:
        self._cleared(*_opened(self.path))

    def _cleared(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        if [f.name for f in schema.fields] != ["name", "value"]:
            raise ValueError("named files need the columns name and value")
        return NamedFilesWriter(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(NamedFiles)
    return spark


def write_named(results: DataFrame, folder: str, extension: str = "") -> None:
    """Writes results(name, value), a file for each row, each under the name of its input with the extension added."""
    from pyspark.sql import functions as F

    named = results.select(F.concat("name", F.lit(f".{extension}" if extension else "")).alias("name"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    registered(results.sparkSession)
    named.write.format(FORMAT).option("path", folder).mode("append").save()
