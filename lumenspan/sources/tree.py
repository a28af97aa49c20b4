"""A folder tree as a table or a stream of changes (SRC1, SRC2, STR2, FLT1-FLT3).

    spark.dataSource.register(FileTree)
    spark.read.format("file_tree").option("path", root).load()
    spark.readStream.format("file_tree").option("path", root).option("manifests", folder).load()

Folders are the partitions: the driver lists the top ``depth`` levels only, each folder of
the last one is walked by a task, and skipped folders are never entered. The stream's
offset is the number of a cycle. A task keeps what it saw in a manifest for each cycle
(path, time, size, in walking order) and returns the difference to the manifest of the
cycle before; the same cycle read again answers from its manifests, so a batch that is
run again is the same. Both manifests are read side by side, so memory doesn't grow
with the tree. Local paths (of a file system that all executors see) and the file
systems that pyarrow knows are read.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import os
import re
import shutil
import stat
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import words

SMALLEST, LARGEST = 10, 500_000_000
#: Rows and bytes of contents in one batch.
ROWS, BYTES = 1000, 16 << 20
SCHEMA = "path string, is_folder boolean, modified_at timestamp, size_bytes long, change string, content binary"
PRESENT, ADDED, CHANGED, DELETED = "present", "added", "changed", "deleted"

_SKIPPED = {w.lower() for w in words.EXCLUDED_FOLDERS}
_GENERATED = re.compile(r"^.{8}-.{4}-.{4}-.{4}-.{12}$|^[0-9a-fA-F-]{16,}$")
_SYSTEM = 0x4


def skipped(name: str) -> bool:
    """FLT2, FLT3 for a folder's own name."""
    low = name.lower()
    return name.startswith(".") or low in _SKIPPED or low.endswith(tuple(words.PACKAGE_SUFFIXES)) or bool(_GENERATED.match(name))


def local(path: str) -> str | None:
    """A local path without its scheme; None for other file systems."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True, order=True)
class Entry:
    """A file or folder; files have a time in microseconds and a size."""

    name: str
    is_folder: bool
    time: int = 0
    size: int = 0


def children(folder: str) -> list[Entry]:
    """What is worth a look in a folder, by name: no links, system or special files, no skipped folders. A folder that is gone or closed has nothing."""
    out, own = [], local(folder)
    try:
        if own is not None:
            with os.scandir(own) as found:
                for e in found:
                    info = e.stat(follow_symlinks=False)
                    if stat.S_ISDIR(info.st_mode):
                        out.append(Entry(e.name, True, info.st_mtime_ns // 1000))
                    elif stat.S_ISREG(info.st_mode) and not getattr(info, "st_file_attributes", 0) & _SYSTEM:
                        out.append(Entry(e.name, False, info.st_mtime_ns // 1000, info.st_size))
        else:
            from pyarrow import fs

            system, where = _remote(folder)
            for info in system.get_file_info(fs.FileSelector(where)):
                out.append(Entry(info.base_name, info.type == fs.FileType.Directory, (info.mtime_ns or 0) // 1000, info.size or 0))
    except (FileNotFoundError, NotADirectoryError, PermissionError):
        return []
    return sorted(e for e in out if (not skipped(e.name) if e.is_folder else SMALLEST <= e.size <= LARGEST))


def walk(root: str, deep: bool = True, look: Callable[[str], list[Entry]] = children) -> Iterator[tuple[str, Entry]]:
    """(path, entry) of everything below a folder, by name within each folder; a folder comes before what it holds. Not ``deep``: its own files only."""
    open_folders = [(root.rstrip("/"), iter(look(root)))]
    while open_folders:
        folder, rest = open_folders[-1]
        entry = next(rest, None)
        if entry is None:
            open_folders.pop()
        elif deep or not entry.is_folder:
            path = f"{folder}/{entry.name}"
            yield path, entry
            if entry.is_folder:
                open_folders.append((path, iter(look(path))))


@dataclass
class Branch(InputPartition):
    """A folder that one task walks: all below it, or its own files only. With cycles: what changed from ``start`` to ``end``."""

    folder: str
    deep: bool
    shown: int | None = None  # the folder's own time, where it is a row of its own
    start: int = 0
    end: int = 0

    @property
    def name(self) -> str:
        return hashlib.sha256(f"{self.deep} {self.folder}".encode()).hexdigest()[:32]


def branches(roots: list[str], depth: int, look: Callable[[str], list[Entry]] = children) -> list[Branch]:
    """The folders of the top ``depth`` levels with their own files only, and those of the level below as a whole."""
    out, level = [], [(r.rstrip("/") or "/", None) for r in roots]
    for _ in range(depth):
        out.extend(Branch(folder, False, when) for folder, when in level)
        level = [(f"{folder.rstrip('/')}/{e.name}", e.time) for folder, _ in level for e in look(folder) if e.is_folder]
    return out + [Branch(folder, True, when) for folder, when in level]


def order(path: str) -> tuple[str, ...]:
    """Walking order of paths."""
    return tuple(path.split("/"))


def differences(before: Iterator[tuple[str, int, int]], after: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(path, time, size, change) of two lists of files in walking order; a file is changed when its time or size is."""
    old, new = next(before, None), next(after, None)
    while old or new:
        if new is None or (old is not None and order(old[0]) < order(new[0])):
            yield (*old, DELETED)
            old = next(before, None)
        elif old is None or order(new[0]) < order(old[0]):
            yield (*new, ADDED)
            new = next(after, None)
        else:
            if old[1:] != new[1:]:
                yield (*new, CHANGED)
            old, new = next(before, None), next(after, None)


class Manifests:
    """The files that each branch had in each cycle, below a folder that driver and executors share."""

    def __init__(self, folder: str):
        self.folder = local(folder) or folder
        self.remote = local(folder) is None

    def _path(self, cycle: int, name: str) -> str:
        return f"{self.folder}/cycle={cycle}/{name}"

    def read(self, cycle: int, name: str) -> Iterator[list] | None:
        """A manifest's lines; None if there is none."""
        try:
            if self.remote:
                system, where = _remote(self._path(cycle, name))
                held = io.TextIOWrapper(system.open_input_stream(where), "utf-8")
            else:
                held = open(self._path(cycle, name), encoding="utf-8")
        except FileNotFoundError:
            return None
        return self._lines(held)

    @staticmethod
    def _lines(held) -> Iterator[list]:
        with held:
            for x in held:
                yield json.loads(x)

    def write(self, cycle: int, name: str, rows: Iterator) -> None:
        """Writes a manifest beside its place and moves it there, so readers never see half of it."""
        path = self._path(cycle, name)
        part = f"{path}.{os.getpid()}-{time.time_ns()}"
        if self.remote:
            system, where = _remote(part)
            system.create_dir(where.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(where) as out:
                for r in rows:
                    out.write((json.dumps(r, ensure_ascii=False) + "\n").encode())
            system.move(where, _remote(path)[1])
            return
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "w", encoding="utf-8") as out:
            for r in rows:
                out.write(json.dumps(r, ensure_ascii=False) + "\n")
        os.replace(part, path)

    def forget(self, before: int) -> None:
        """Removes the manifests of cycles before ``before``."""
        if self.remote:
            from pyarrow import fs

            system, where = _remote(self.folder)
            found = [i.path for i in system.get_file_info(fs.FileSelector(where, allow_not_found=True))]
        else:
            found = [f"{self.folder}/{n}" for n in os.listdir(self.folder)] if os.path.isdir(self.folder) else []
        for path in found:
            head, _, cycle = path.rsplit("/", 1)[-1].partition("=")
            if head == "cycle" and cycle.isdigit() and int(cycle) < before:
                system.delete_dir(path) if self.remote else shutil.rmtree(path, ignore_errors=True)


def contents(path: str) -> bytes | None:
    """A file's bytes; None if it can't be read."""
    try:
        own = local(path)
        if own is not None:
            with open(own, "rb") as f:
                return f.read()
        system, where = _remote(path)
        with system.open_input_stream(where) as f:
            return f.read()
    except OSError:
        return None


def put(path: str, data: bytes | None) -> None:
    """Writes a file, making its folders; None removes it if it is there."""
    own = local(path)
    if own is not None:
        if data is None:
            if os.path.exists(own):
                os.remove(own)
            return
        os.makedirs(os.path.dirname(own), exist_ok=True)
        with open(own, "wb") as f:
            f.write(data)
        return
    system, where = _remote(path)
    if data is None:
        with contextlib.suppress(FileNotFoundError):
            system.delete_file(where)
        return
    system.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(where) as f:
        f.write(data)


def _batches(rows: Iterator[tuple[str, bool, int, int, str]], schema: StructType, content: bool) -> Iterator[pa.RecordBatch]:
    arrow, held, size = to_arrow_schema(schema), [], 0

    def batch():
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    for path, is_folder, when, length, change in rows:
        data = contents(path) if content and not is_folder and change != DELETED else None
        held.append((path, is_folder, when, length, change, data))
        size += len(data or b"")
        if len(held) >= ROWS or size >= BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class FileTree(DataSource):
    """Options: path (several apart by new lines), depth (levels that the driver lists, 2), content (false), manifests (streams only).

    Rows of a table: every file and folder that is worth a look, ``change`` is "present". Rows of
    a stream: files that were added, changed or deleted since the cycle before. Unreadable
    contents are null.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def _settings(self) -> tuple[list[str], int, bool]:
        roots = [local(r) or r for r in (self.options.get("path") or "").split("\n") if r]
        if not roots:
            raise ValueError("file_tree needs a path")
        return roots, int(self.options.get("depth") or 2), (self.options.get("content") or "false").lower() == "true"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(schema, *self._settings())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        folder = self.options.get("manifests")
        if not folder:
            raise ValueError("a stream of file_tree needs a folder for its manifests")
        return TreeStream(schema, *self._settings(), folder)


class TreeReader(DataSourceReader):
    def __init__(self, schema: StructType, roots: list[str], depth: int, content: bool):
        self.made, self.roots, self.depth, self.content = schema, roots, depth, content

    def partitions(self) -> list[Branch]:
        return branches(self.roots, self.depth)

    def read(self, partition: Branch) -> Iterator[pa.RecordBatch]:
        def rows():
            if partition.shown is not None:
                yield partition.folder, True, partition.shown, 0, PRESENT
            for path, e in walk(partition.folder, partition.deep):
                yield path, e.is_folder, e.time, e.size, PRESENT

        return _batches(rows(), self.made, self.content)


class TreeStream(DataSourceStreamReader):
    def __init__(self, schema: StructType, roots: list[str], depth: int, content: bool, folder: str):
        self.made, self.roots, self.depth, self.content = schema, roots, depth, content
        self.manifests, self.last = Manifests(folder), 0

    def initialOffset(self) -> dict:
        return {"cycle": 0}

    def latestOffset(self) -> dict:
        self.last = max(self.last + 1, time.time_ns() // 1_000_000)
        return {"cycle": self.last}

    def _branches(self, cycle: int) -> list[tuple[str, bool]]:
        return [tuple(x) for x in self.manifests.read(cycle, "branches") or ()]

    def partitions(self, start: dict, end: dict) -> list[Branch]:
        first, last = start["cycle"], end["cycle"]
        if self.manifests.read(last, "branches") is None:
            self.manifests.write(last, "branches", ([b.folder, b.deep] for b in branches(self.roots, self.depth)))
        # Branches that are gone have files to report too.
        return [Branch(folder, deep, None, first, last) for folder, deep in sorted({*self._branches(first), *self._branches(last)})]

    def read(self, partition: Branch) -> Iterator[pa.RecordBatch]:
        p, held = partition, self.manifests
        if held.read(p.end, p.name) is None:
            held.write(p.end, p.name, ([path, e.time, e.size] for path, e in walk(p.folder, p.deep) if not e.is_folder))
        before, after = (map(tuple, held.read(c, p.name) or ()) for c in (p.start, p.end))
        return _batches(((path, False, when, size, change) for path, when, size, change in differences(before, after)), self.made, self.content)

    def commit(self, end: dict) -> None:
        self.manifests.forget(end["cycle"])
