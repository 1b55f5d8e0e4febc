"""A registered source of artifact trees in a shared, mounted folder: listed in order, split by size, links and odd files refused.

    register(spark)
    spark.read.format("artifact_tree").option("split", 64 << 20).load(root).where("path like 'runs/%'")

Stores without links are read by ``artifacts.artifact_files``, which needs no mount. Here the tree is walked once when the query is
planned, names and sizes only; contents are read in the tasks that return them. Comparisons of ``path`` with a literal and
prefixes are pushed down: other folders' files are neither listed nor opened, but every folder's own kind is checked.
"""

from __future__ import annotations

import datetime
import fnmatch
import hashlib
import os
import stat
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SPLIT_BYTES = 32 << 20
# What opening a file costs, in bytes read: so many small files make a split of their own.
OPEN_BYTES = 64 << 10
SCHEMA = "path string, length long, modified timestamp, content binary, revision string"


class UnsafeTree(ValueError):
    """A link, a special file or a name that isn't a plain path segment."""


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def in_units(name: str) -> bytes:
    """Names are ordered by their UTF-16 units."""
    return name.encode("utf-16-be", "surrogatepass")


def listed(root: str, prefixes: tuple[str, ...] = ("",)) -> Iterator[tuple[str, int]]:
    """(path below the root, size) of all files that begin with one of ``prefixes``, folder by folder in the order of their names.

    Every entry that is met is checked; below a folder in which no prefix can lie nothing is.
    """
    if stat.S_ISLNK(os.lstat(root).st_mode) or not stat.S_ISDIR(os.lstat(root).st_mode) or os.path.realpath(root) != os.path.abspath(root):
        raise UnsafeTree(f"unsafe root: {root}")

    def below(folder: str) -> Iterator[tuple[str, int]]:
        with os.scandir(os.path.join(root, folder)) as found:
            entries = sorted(found, key=lambda e: in_units(e.name))
        for entry in entries:
            path = f"{folder}{entry.name}"
            if "\\" in entry.name or entry.is_symlink():
                raise UnsafeTree(f"unsafe path: {path}")
            if entry.is_dir(follow_symlinks=False):
                if any(p.startswith(f"{path}/") or f"{path}/".startswith(p) for p in prefixes):
                    yield from below(f"{path}/")
            elif not entry.is_file(follow_symlinks=False):
                raise UnsafeTree(f"unsafe file type: {path}")
            elif path.startswith(prefixes):
                yield path, entry.stat(follow_symlinks=False).st_size

    yield from below("")


def splits(files: Iterable[tuple[str, int]], most: int) -> list[Files]:
    """Consecutive files, up to ``most`` bytes with what opening them costs; a larger file is a split of its own."""
    out: list[Files] = []
    size = most
    for path, length in files:
        cost = length + OPEN_BYTES
        if size + cost > most:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(path)
        size += cost
    return out or [Files([])]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        root = options.get("path") or ""
        self.root = os.path.abspath(root.removeprefix("file://"))
        self.pattern, self.split = options.get("pattern"), int(options.get("split", SPLIT_BYTES))
        self.wanted: list[tuple[str, ...]] = []
        self.exact: list[frozenset[str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.exact.append(frozenset([f.value]))
            elif isinstance(f, In) and f.attribute == ("path",):
                self.exact.append(frozenset(v for v in f.value if v is not None))
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.wanted.append((f.value,))
            else:
                yield f

    def partitions(self) -> list[Files]:
        # Conditions hold together: the walk follows one of them, what it finds is held against all.
        walk = tuple(self.exact[0]) if self.exact else self.wanted[0] if self.wanted else ("",)
        found = (f for f in listed(self.root, walk) if all(f[0] in e for e in self.exact) and all(f[0].startswith(w) for w in self.wanted)) if walk else ()
        if self.pattern:
            found = (f for f in found if fnmatch.fnmatchcase(f[0].rsplit("/", 1)[-1], self.pattern))
        return splits(found, self.split)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            full = os.path.join(self.root, path)
            # What is opened is what was listed: no link has taken the place of the file or of a folder above it.
            handle = os.open(full, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
            with os.fdopen(handle, "rb") as file:
                status = os.fstat(handle)
                if not stat.S_ISREG(status.st_mode) or os.path.realpath(full) != full:
                    raise UnsafeTree(f"unsafe path: {path}")
                content = file.read()
            modified = datetime.datetime.fromtimestamp(status.st_mtime, datetime.UTC)
            yield path, len(content), modified, content, f"sha256:{hashlib.sha256(content).hexdigest()}"


class ArtifactTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArtifactTree)
