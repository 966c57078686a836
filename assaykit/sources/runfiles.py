"""Run files written by executors: one JSON document for each row, named after it, all of a write or none."""

from __future__ import annotations

import contextlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def store_of(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """Write a file, with the folders above it."""
    store, at = store_of(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(data)


def content(path: str) -> bytes | None:
    """A file's bytes; None if it isn't there."""
    store, at = store_of(path)
    try:
        with store.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def names(folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    from pyarrow import fs

    store, at = store_of(folder)
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)))


def delete(path: str) -> None:
    """Delete a file, if it is there."""
    store, at = store_of(path)
    with contextlib.suppress(FileNotFoundError):
        store.delete_file(at)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class RunFiles(DataSource):
    """df.write.format("run_files"): rows (name, document) as folder/{name}.json.

    Option path: the folder, which driver and executors share. Tasks write into a folder of their
    attempt, which a commit empties into place and an abort deletes. A name that occurs twice, or whose
    file is there with another content (but in mode overwrite), fails the write before any file is in place. A file that
    is there with the same content is left, so a write that broke off while it put files in place can be repeated.
    """

    @classmethod
    def name(cls) -> str:
        return "run_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _RunWriter(self.options["path"].rstrip("/"), overwrite)


class _RunWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.attempt = folder, overwrite, f"_attempts/{uuid.uuid4().hex}"

    def write(self, iterator) -> WriterCommitMessage:
        names, own = [], uuid.uuid4().hex  # a task that is tried again has a folder of its own
        for name, document in iterator:
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"a run can't be named {name!r}")
            put(f"{self.folder}/{self.attempt}/{own}/{name}.json", (document + "\n").encode())
            names.append(f"{own}/{name}.json")
        return _Written(names)

    def commit(self, messages) -> None:
        whence: dict[str, list[str]] = {}
        for name in (n for m in messages for n in m.names):
            whence.setdefault(name.split("/", 1)[1], []).append(f"{self.folder}/{self.attempt}/{name}")
        twice = sorted(n for n, paths in whence.items() if len(paths) > 1)
        there = set(names(self.folder)) & set(whence)
        same = {n for n in there if not twice and content(f"{self.folder}/{n}") == content(whence[n][0])}
        if twice or (there - same and not self.overwrite):
            self.abort(messages)
            raise FileExistsError(f"{self.folder}: {(twice or sorted(there - same))[0]} {'occurs twice' if twice else 'is there with another content'}")
        store, at = store_of(self.folder)
        for name, (path,) in whence.items():
            if name not in same:
                store.move(store_of(path)[1], f"{at}/{name}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        store, at = store_of(f"{self.folder}/{self.attempt}")
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(at)


def save_runs(runs: DataFrame, folder: str, name: str = "run_id", overwrite: bool = False) -> None:
    """Each row of runs as folder/{its name}.json, written by executors. What fails a write: RunFiles. No rows write nothing."""
    spark = runs.sparkSession
    spark.dataSource.register(RunFiles)
    rows = runs.select(F.col(name).cast("string").alias("name"), F.to_json(F.struct("*"), {"pretty": "true"}).alias("document"))
    rows.write.format("run_files").mode("overwrite" if overwrite else "append").save(folder)
