"""A directory tree as a data source: ``spark.read.format("tree")`` after ``register(spark)``.

Options: path; branches (JSON list of folders to stay in); cursor (a folder: what lies before it in path order is
passed over); mounts (text of the mount table: other file systems below the root are passed over); parts (tasks, 64);
identity (true: each task also gives the root itself, with an empty rel_path, as it is at its begin and at its end). A tree is read by
all executors, which must all see it: folders from the root down are dealt out, so that neither one deep folder nor a
flat root is left to one task. Links are not followed. What cannot be read is a row with its error number, the root itself among it (folder is
true for a folder that could not be listed, null where nothing is known), so that a walk with errors can be told from a whole one."""

from __future__ import annotations

import json
import os
import stat
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "rel_path string, folder boolean, dev long, ino long, size long, mtime_ns long, ctime_ns long, atime_ns long, nlink int, uid long, mode int, blocks long, marked boolean, errno int"
MARKER = ".nodedup"


def mount_points(table: str) -> set[str]:
    """Mount points (field 5) of a mount table; \\040 and the like stand for characters."""
    out = set()
    for line in table.splitlines():
        fields = line.split(" ")
        if len(fields) > 4:
            point = fields[4]
            for code, char in (("\\040", " "), ("\\011", "\t"), ("\\012", "\n"), ("\\134", "\\")):
                point = point.replace(code, char)
            out.add(point)
    return out


def descends(folder: str, branches: list[str]) -> bool:
    """Whether to enter a folder: it is in a branch, or above one."""
    own = folder.split("/") if folder else []
    return not branches or any(own[: len(b)] == b or b[: len(own)] == own for b in (x.split("/") if x else [] for x in branches))


def inside(path: str, branches: list[str]) -> bool:
    own = path.split("/")
    return not branches or any(own[: len(b)] == b for b in (x.split("/") if x else [] for x in branches))


def passed(folder: str, cursor: str | None) -> bool:
    """Whether a folder lies wholly before the cursor in path order."""
    if not cursor:
        return False
    own, at = folder.split("/"), cursor.split("/")
    return own < at and at[: len(own)] != own


#: Files of one folder that a task looks at; larger folders are dealt to several.
FILES = 10_000


class Unit(InputPartition):
    """What one task walks: (folder, marked, part, parts), with part -1 for all below the folder and else one part of its own files."""

    def __init__(self, todo: list[tuple[str, bool, int, int]]) -> None:
        super().__init__(None)
        self.todo = todo


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.branches = json.loads(options.get("branches", "[]"))
        self.cursor = options.get("cursor")
        self.mounts = mount_points(options.get("mounts", ""))
        self.parts = int(options.get("parts", "64"))
        self.identity = options.get("identity", "false").lower() == "true"

    def _full(self, rel: str) -> str:
        return f"{self.root}/{rel}" if rel else self.root

    def _enters(self, rel: str, dev: int, domain: int) -> bool:
        return descends(rel, self.branches) and not passed(rel, self.cursor) and not ((self._full(rel) in self.mounts or not self.mounts) and dev != domain)

    def partitions(self) -> list[Unit]:
        """Folders are listed from the root down until there are enough to deal out. What is listed here is not walked again: a listed folder
        becomes its own files, in parts if there are many, and a unit for each folder in it. A folder that cannot be listed stays a unit, so that its task tells the error."""
        try:
            domain = os.stat(self.root).st_dev
        except OSError:
            return [Unit([("", False, -1, 1)])]
        files, trees = [], [("", False)]
        listed = 0
        while trees and len(trees) + len(files) < self.parts and listed < 8 * self.parts:
            rel, marked = trees.pop(0)
            listed += 1
            try:
                with os.scandir(self._full(rel)) as found:
                    entries = [(e.name, e.is_dir(follow_symlinks=False), e) for e in found]
                below = sorted(n if not rel else f"{rel}/{n}" for n, folder, e in entries if folder)
            except OSError:
                files.append((rel, marked, -1, 1))
                continue
            marked = marked or any(n == MARKER for n, _, _ in entries)
            n = sum(not folder for _, folder, _ in entries)
            parts = max(1, -(-n // FILES))
            files += [(rel, marked, k, parts) for k in range(parts)]
            trees += [(x, marked) for x in below if self._walkable(x, domain)]
        units = files + [(rel, marked, -1, 1) for rel, marked in trees]
        return [Unit(units[k :: self.parts]) for k in range(min(self.parts, len(units)))]

    def _walkable(self, rel: str, domain: int) -> bool:
        try:
            return self._enters(rel, os.lstat(self._full(rel)).st_dev, domain)
        except OSError:
            return True

    def _row(self, rel: str, s: os.stat_result, marked: bool) -> tuple:
        return (rel, stat.S_ISDIR(s.st_mode), s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_atime_ns, s.st_nlink, s.st_uid, s.st_mode, s.st_blocks, marked, None)

    def _error(self, rel: str, folder: bool | None, marked: bool, e: OSError) -> tuple:
        return (rel, folder, *[None] * 10, marked, e.errno)

    def _self(self) -> tuple:
        """The root as it is now."""
        try:
            return self._row("", os.stat(self.root), False)
        except OSError as e:
            return self._error("", True, False, e)

    def read(self, partition: Unit) -> Iterator[tuple]:
        if self.identity:
            yield self._self()
        for unit in partition.todo:
            yield from self._walk(*unit)
        if self.identity:
            yield self._self()

    def _walk(self, start: str, marked: bool, part: int, parts: int) -> Iterator[tuple]:
        try:
            domain = os.stat(self.root).st_dev
        except OSError as e:
            yield self._error(start, True, marked, e)
            return
        todo = [(start, marked)]
        while todo:
            rel, marked = todo.pop()
            try:
                s = os.lstat(self._full(rel)) if rel else os.stat(self.root)
            except OSError as e:
                yield self._error(rel, None, marked, e)
                continue
            if not stat.S_ISDIR(s.st_mode):
                if stat.S_ISREG(s.st_mode) and inside(rel, self.branches):
                    yield self._row(rel, s, marked)
                continue
            if rel and not self._enters(rel, s.st_dev, domain):
                continue
            try:
                names = sorted(os.listdir(self._full(rel)), reverse=True)
            except OSError as e:
                yield self._error(rel, True, marked, e)
                continue
            marked = marked or MARKER in names
            if rel and part < 1:
                yield self._row(rel, s, marked)
            below = [(f"{rel}/{n}" if rel else n, marked) for n in names]
            if part < 0:
                todo += below
            else:
                yield from self._own(below, part, parts)

    def _own(self, below: list[tuple[str, bool]], part: int, parts: int) -> Iterator[tuple]:
        """One part of a folder's own files; its folders are other units."""
        for rel, marked in reversed(below):
            if parts > 1 and zlib.crc32(rel.encode(errors="surrogateescape")) % parts != part:
                continue
            try:
                s = os.lstat(self._full(rel))
            except OSError as e:
                yield self._error(rel, None, marked, e)
                continue
            if stat.S_ISREG(s.st_mode) and inside(rel, self.branches):
                yield self._row(rel, s, marked)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tree)


def read_exact(path: str, offset: int, size: int) -> bytes:
    """``size`` bytes of a file from an offset on; fewer are an error."""
    with open(path, "rb") as f:
        f.seek(offset)
        data = f.read(size)
    if len(data) != size:
        raise EOFError(f"{path}: {len(data)} of {size} bytes at {offset}")
    return data
