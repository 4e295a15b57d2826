"""A data source that writes each document to a file of its own, `<out>/<path>/<basename>.md`, and what reads them.

    documents.write.format("document_files").mode("append").save(out)

takes rows (path, basename, markdown), and

    documents_below(spark, out, parts)

gives rows (folder, name, markdown) of all Markdown files below a folder. Every folder is listed once, by one task, which
streams its names; folders are dealt over tasks for listing and files for reading, so that a folder of many files is read
by all tasks and the driver lists nothing. With mode append, documents whose file is there are left as they are; with mode
overwrite, each is replaced for itself, and files of other documents stay. With the option copies, a document's file is
also written as `<out>/batch-process/<path>.md`.

A task first writes all its files to a folder of its own under `<out>/.staging-<job>`, then a list of those that will be
new, and then moves them to their places. So nothing is seen of a task that fails before, readers never see half a file, and
a task that is tried again finds what is there. When the job ends, the staging folder goes; when it is given up, so do the
files that it made, by those lists, whichever task made them. A mark `.given-up-<job>` then stays, as tasks may still run:
they look for it after their moves and undo them. What the driver handles is a row for each task, never one for
each file.

Rows with a null path, basename or markdown have no file. Markdown may be empty, and texts are written as they are, in
UTF-8. Paths must be unique, as sinks.unique_paths makes them: of equal ones, any is kept. Paths that are absolute or lead
out of the folder are errors.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

COLUMNS = ("path", "basename", "markdown")
BATCH_FOLDER = "batch-process"
#: Bytes of texts and rows of names in a batch that a task gives.
BATCH_BYTES, NAMES = 4 << 20, 10_000
#: Of an entry: the folder that it is in, relative to the output folder and empty for its own, its name, and whether it is a folder.
ENTRIES, FILES = "folder string, name string, is_folder boolean", "folder string, name string, markdown string"


@dataclass
class Written(WriterCommitMessage):
    written: int
    there: int


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        missing = [c for c in COLUMNS if c not in schema.names]
        if missing or "path" not in self.options:
            raise ValueError(f"columns {COLUMNS} and a path are needed")
        return DocumentWriter(self.options["path"], overwrite, str(self.options.get("copies", "false")).lower() == "true")


def opened(out: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark takes it, in which nothing is escaped, and the path in it."""
    found = re.match(r"([A-Za-z][\w+.-]*):(//[^/]*)?(/.*)?\Z", out, re.S)
    if not found or found[1] == "file":
        return fs.LocalFileSystem(), (found[3] or "/") if found else out
    return fs.FileSystem.from_uri(f"{found[1]}:{found[2] or '//'}{quote(found[3] or '/')}")


def place(path: str, basename: str) -> str:
    """A document's file below the output folder."""
    whole = f"{path}/{basename}.md"
    if any(part in ("", ".", "..") or "\0" in part or "\\" in part for part in whole.split("/")):
        raise ValueError(f"not a place for a document: {whole!r}")
    return whole


def documents_below(spark: SparkSession, out: str, parts: int) -> DataFrame:
    """Rows (folder, name, markdown) of the Markdown files below a folder, read by so many tasks."""
    out = out.rstrip("/")
    tops = spark.range(0, 1, 1, 1).mapInArrow(partial(_tops, out), ENTRIES)
    found = tops.repartition(parts, "folder", "name").mapInArrow(partial(_below, out), ENTRIES)
    return found.repartition(parts, "folder", "name").mapInArrow(partial(_texts, out), FILES)


def _listed(store: fs.FileSystem, root: str, folder: str) -> Iterator[tuple[str, str, bool]]:
    """Entries (folder, name, is_folder) of one folder. Local ones are streamed, without asking for each file's state."""
    at = f"{root}/{folder}" if folder else root
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(at) as found:
            for x in found:
                if (is_folder := x.is_dir()) or x.is_file():
                    yield folder, x.name, is_folder
    else:
        for x in store.get_file_info(fs.FileSelector(at)):
            if x.type in (fs.FileType.Directory, fs.FileType.File):
                yield folder, x.base_name, x.type == fs.FileType.Directory


def _tops(out: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the output folder, but for hidden ones, as those that jobs work in."""
    store, root = opened(out)
    for batch in batches:
        if batch.num_rows:
            yield from _named(x for x in _listed(store, root, "") if not x[1].startswith("."))


def _below(out: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Markdown files among and below entries."""
    store, root = opened(out)

    def walked(entries: Iterator[tuple[str, str, bool]]) -> Iterator[tuple[str, str, bool]]:
        folders: list[str] = []
        for folder, name, is_folder in entries:
            if is_folder:
                folders.append(f"{folder}/{name}" if folder else name)
                while folders:
                    for at, own, is_below in _listed(store, root, folders.pop()):
                        if is_below:
                            folders.append(f"{at}/{own}")
                        elif own.endswith(".md"):
                            yield at, own, False
            elif name.endswith(".md"):
                yield folder, name, False

    yield from _named(walked(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)))


def _named(entries: Iterator[tuple[str, str, bool]]) -> Iterator[pa.RecordBatch]:
    while rows := list(islice(entries, NAMES)):
        folder, name, is_folder = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(folder, pa.string()), pa.array(name, pa.string()), pa.array(is_folder, pa.bool_())], names=["folder", "name", "is_folder"])


def _texts(out: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in the files of entries (folder, name)."""
    store, root = opened(out)
    rows, size = [], 0
    for batch in batches:
        for folder, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with store.open_input_stream(f"{root}/{folder}/{name}" if folder else f"{root}/{name}") as stream:
                rows.append((folder, name, stream.read()))
            size += len(rows[-1][2])
            if size > BATCH_BYTES:
                yield _batch(rows)
                size = 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    folder, name, content = zip(*rows)
    rows.clear()
    texts = pa.array([c.decode("utf-8", "replace") for c in content], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(folder, pa.string()), pa.array(name, pa.string()), texts], names=["folder", "name", "markdown"])


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, out: str, overwrite: bool, copies: bool):
        self.out, self.overwrite, self.copies = out.rstrip("/"), overwrite, copies
        self.job = uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/.staging-{self.job}"

    def _mark(self, root: str) -> str:
        return f"{root}/.given-up-{self.job}"

    def _places(self, path: str, basename: str) -> list[str]:
        return [place(path, basename), *([place(BATCH_FOLDER, path)] if self.copies else [])]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.out)
        context = TaskContext.get()
        own = f"{self._staging(root)}/{context.partitionId()}-{context.taskAttemptId()}"
        moves: list[tuple[str, str, bool]] = []
        there, n = 0, 0
        for batch in iterator:
            rows = [r for r in zip(*(batch.column(c).to_pylist() for c in COLUMNS)) if None not in r]
            wanted = [(f"{root}/{at}", text) for path, basename, text in rows for at in self._places(path, basename)]
            known = store.get_file_info([at for at, _ in wanted]) if wanted else []
            for (at, text), info in zip(wanted, known):
                exists = info.type != fs.FileType.NotFound
                if exists and not self.overwrite:
                    there += 1
                    continue
                if not n:
                    store.create_dir(own)
                n += 1
                with store.open_output_stream(f"{own}/{n}") as file:
                    file.write(text.encode())
                moves.append((f"{own}/{n}", at, not exists))
        if moves:
            with store.open_output_stream(f"{own}/made") as file:
                file.write(json.dumps([at for _, at, new in moves if new]).encode())
        for folder in dict.fromkeys(at.rpartition("/")[0] for _, at, _ in moves):
            store.create_dir(folder)
        for staged, at, _ in moves:
            _move(store, staged, at)
        if store.get_file_info(self._mark(root)).type != fs.FileType.NotFound:
            _undo(store, own)
            raise RuntimeError("the job has been given up")
        return Written(len(moves), there)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.out)
        _drop(store, self._staging(root))

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.out)
        store.create_dir(root)
        store.open_output_stream(self._mark(root)).close()
        for task in store.get_file_info(fs.FileSelector(self._staging(root), allow_not_found=True)):
            _undo(store, task.path)
        _drop(store, self._staging(root))


def _move(store: fs.FileSystem, staged: str, at: str) -> None:
    try:
        store.move(staged, at)
    except OSError:  # stores that do not replace
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_file(at)
        store.move(staged, at)


def _undo(store: fs.FileSystem, own: str) -> None:
    """Delete the files that a task's list says are new, and its folder."""
    if store.get_file_info(f"{own}/made").type != fs.FileType.NotFound:
        with store.open_input_stream(f"{own}/made") as file:
            made = json.loads(file.read())
        for at in made:
            if store.get_file_info(at).type != fs.FileType.NotFound:
                store.delete_file(at)
    _drop(store, own)


def _drop(store: fs.FileSystem, folder: str) -> None:
    if store.get_file_info(folder).type != fs.FileType.NotFound:
        store.delete_dir(folder)
