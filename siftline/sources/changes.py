"""Changes of a directory tree as a stream: ``spark.readStream.format("tree_changes")`` after ``register(spark)``.

Each micro-batch compares the tree with how it was one generation before. Options: path; log (a folder that all executors share and that only
this stream writes to); parts (tasks, 16); depth (folders down to it are dealt to the tasks by a hash of their path, 2); every_ms (the least time
between generations, 0).

An offset is a generation's number. A task lists its folders, writes the listing of that generation to the log and only then gives the differences; a
task that runs again, after a failure or a restart from the checkpoint, finds the listing there and gives the same rows. So nothing is
lost and nothing comes twice. Listings before the last committed generation are removed. The first generation is what is there at the start and gives no rows.

Rows are raw changes as ``operators.pairing.located`` takes them: a file that has come or gone is half of a rename with its inode as tracker, since only
another task may know where it went; a file whose size or times are others was written to. A folder that cannot be read keeps its old listing and asks for a
rescan: what is unreadable is not gone."""

from __future__ import annotations

import json
import os
import stat
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "seq long, ts timestamp, raw string, folder boolean, tracker long, path string, to_path string"


def _local(path: str) -> str:
    return path.removeprefix("file://").rstrip("/") or "/"


class Part(InputPartition):
    def __init__(self, number: int, start: int, end: int) -> None:
        super().__init__(number)
        self.number, self.start, self.end = number, start, end


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.log = _local(options["path"]), _local(options["log"])
        self.parts, self.depth = int(options.get("parts", "16")), int(options.get("depth", "2"))
        self.every_ms = int(options.get("every_ms", "0"))

    # Offsets, on the driver.

    def _times(self) -> dict[int, int]:
        """When each generation that was begun began (milliseconds)."""
        at = f"{self.log}/generations"
        if not os.path.isdir(at):
            return {}
        return {int(n.split("-")[0]): int(n.split("-")[1]) for n in os.listdir(at)}

    def _begin(self, generation: int) -> None:
        os.makedirs(f"{self.log}/generations", exist_ok=True)
        with open(f"{self.log}/generations/{generation}-{int(time.time() * 1000)}", "w"):
            pass

    def initialOffset(self) -> dict:
        if 0 not in self._times():
            self._begin(0)
        return {"generation": 0}

    def latestOffset(self) -> dict:
        times = self._times()
        last = max(times, default=-1)
        if last < 0:
            return self.initialOffset()
        if time.time() * 1000 - times[last] >= self.every_ms:
            last += 1
            self._begin(last)
        return {"generation": last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(k, start["generation"], end["generation"]) for k in range(self.parts)]

    def commit(self, end: dict) -> None:
        for g, at in self._times().items():
            if g < end["generation"]:
                folder = f"{self.log}/{g}"
                if os.path.isdir(folder):
                    for name in os.listdir(folder):
                        os.unlink(f"{folder}/{name}")
                    os.rmdir(folder)
                os.unlink(f"{self.log}/generations/{g}-{at}")

    # Listings, in the tasks.

    def _mine(self, folder: str, number: int) -> bool:
        """Whether the files of a folder belong to a part: by its first folders, so that what lies deep stays together."""
        unit = "/".join(folder.split("/")[: self.depth])
        return zlib.crc32(unit.encode(errors="surrogateescape")) % self.parts == number

    def _list(self, number: int) -> tuple[dict[str, list], list[str]]:
        """Entries of a part's folders (path: [folder, inode, size, mtime, ctime]), and the folders that could not be read."""
        found: dict[str, list] = {}
        unread: list[str] = []
        todo = [""]
        while todo:
            folder = todo.pop()
            mine = self._mine(folder, number)
            level = len(folder.split("/")) if folder else 0
            if not mine and level >= self.depth:
                continue
            try:
                names = sorted(os.listdir(f"{self.root}/{folder}" if folder else self.root))
            except OSError:
                if mine:
                    unread.append(folder)
                continue
            for name in names:
                rel = f"{folder}/{name}" if folder else name
                try:
                    s = os.lstat(f"{self.root}/{rel}")
                except OSError as e:
                    if mine and e.errno != 2:
                        unread.append(rel)
                    continue
                if stat.S_ISDIR(s.st_mode):
                    todo.append(rel)
                if mine and (stat.S_ISDIR(s.st_mode) or stat.S_ISREG(s.st_mode)):
                    found[rel] = [stat.S_ISDIR(s.st_mode), s.st_ino, s.st_size, s.st_mtime_ns, s.st_ctime_ns]
        return found, unread

    def _listing(self, generation: int, number: int, before: dict[str, list]) -> tuple[dict[str, list], list[str]]:
        """A part's listing of a generation, from the log if it is there; else it is made now and written under its name in one step."""
        at = f"{self.log}/{generation}/{number}.json"
        if os.path.exists(at):
            with open(at) as f:
                entries, unread = json.load(f)
            return entries, unread
        found, unread = self._list(number)
        for folder in unread:
            found.update((p, e) for p, e in before.items() if p == folder or not folder or p.startswith(f"{folder}/"))
        os.makedirs(os.path.dirname(at), exist_ok=True)
        draft = f"{at}.{os.getpid()}.{time.time_ns()}"
        with open(draft, "w") as f:
            json.dump([found, unread], f)
        try:
            os.link(draft, at)  # fails if another attempt was first: its listing counts
        except FileExistsError:
            pass
        os.unlink(draft)
        with open(at) as f:
            entries, unread = json.load(f)
        return entries, unread

    def read(self, partition: Part) -> Iterator[tuple]:
        from datetime import datetime, timezone

        times = self._times()
        if partition.start and not os.path.exists(f"{self.log}/{partition.start}/{partition.number}.json"):
            raise FileNotFoundError(f"{self.log} has no listing of generation {partition.start}: changes since then are not known")
        before, _ = self._listing(partition.start, partition.number, {})
        for generation in range(partition.start + 1, partition.end + 1):
            # Generations that began while none was read are one: only the last is listed.
            if generation < partition.end and not os.path.exists(f"{self.log}/{generation}/{partition.number}.json"):
                continue
            now, unread = self._listing(generation, partition.number, before)
            at = datetime.fromtimestamp(times[generation] / 1000, timezone.utc)
            rows = [("overflow", None, None, f"{self.root}/{p}" if p else self.root) for p in sorted(unread)]
            for p in sorted(before.keys() | now.keys()):
                old, new, full = before.get(p), now.get(p), f"{self.root}/{p}"
                if old and new and old[:2] == new[:2]:
                    if not new[0] and old[2:] != new[2:]:
                        rows.append(("close_write", False, None, full))
                    continue
                if old:
                    rows.append(("from", old[0], old[1], full))
                if new:
                    rows.append(("to", new[0], new[1], full))
            # What vanishes comes before what appears, whatever task gives it, so that halves meet in their order.
            for k, (raw, folder, tracker, full) in enumerate(rows):
                late = raw != "from"
                yield ((generation * 2 + late) * self.parts + partition.number) * (1 << 24) + k, at, raw, folder, tracker, full, None
            before = now


class Changes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> ChangesReader:
        return ChangesReader(self.options)


def register(spark: SparkSession) -> None:
    from ..session import let_workers_import

    let_workers_import(spark)
    spark.dataSource.register(Changes)
