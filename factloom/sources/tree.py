"""A source tree as a Spark data source: its files as a batch, its changes as a stream without an outside watcher."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import FEED, SKIPPED, SOURCES, TYPINGS

_SOURCE, _TYPING = re.compile(SOURCES), re.compile(TYPINGS)


def _entries(folder: str) -> tuple[list[os.DirEntry], list[str]]:
    """Source files and folders of a folder by name; skipped folders and links to folders are left out, and one that has gone is empty."""
    try:
        with os.scandir(folder) as found:
            every = sorted(found, key=lambda e: e.name)
    except FileNotFoundError:
        return [], []
    files = [e for e in every if e.is_file() and _SOURCE.search(e.name) and not _TYPING.search(e.name)]
    return files, [e.path for e in every if e.is_dir(follow_symlinks=False) and e.name not in SKIPPED]


def _below(folder: str) -> Iterator[tuple[str, list[os.DirEntry]]]:
    """Each folder below and its source files, in a fixed order."""
    waiting = [folder]
    while waiting:
        here = waiting.pop()
        files, folders = _entries(here)
        yield here, files
        waiting += reversed(folders)


def _content(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace", newline="") as file:
            return file.read()
    except FileNotFoundError:
        return None


@dataclass
class Folder(InputPartition):
    path: str
    whole: bool
    number: int


@dataclass
class Bucket(InputPartition):
    bucket: int
    old: int | None
    new: int | None
    listing: int
    ts: int


class TreeReader(DataSourceReader):
    """Tasks take whole folders; folders are opened, nearest the root first, until there are as many as wanted."""

    def __init__(self, root: str, wanted: int):
        self.root, self.wanted = root, wanted

    def partitions(self) -> list[Folder]:
        opened, whole = [], [self.root]
        while whole and len(opened) + len(whole) < self.wanted:
            opened.append(whole[0])
            whole = whole[1:] + _entries(whole[0])[1]
        return [Folder(path, w, i) for i, (path, w) in enumerate([*((p, False) for p in opened), *((p, True) for p in whole)])]

    def read(self, part: Folder) -> Iterator[tuple]:
        now, n = dt.datetime.now(dt.UTC), part.number << 32
        for _, files in _below(part.path) if part.whole else [(part.path, _entries(part.path)[0])]:
            for entry in files:
                content = _content(entry.path)
                if content is not None:
                    yield n, now, os.path.relpath(entry.path, self.root), "add", content
                    n += 1


class TreeStream(DataSourceStreamReader):
    """Changes between two listings of the tree.

    A listing is a file for each bucket of folders that differs from the last listing's, and a manifest of which file of each
    bucket counts. An offset is a listing's number, so a batch that runs again reads the same two listings. The driver writes a
    listing while it walks the tree and holds one folder at a time; tasks compare a bucket's two files and read contents.
    """

    def __init__(self, root: str, listings: str, buckets: int, initial: bool):
        self.root, self.listings, self.buckets, self.initial = root, listings, buckets, initial

    def _manifest(self, number: int) -> dict:
        if number == 0:
            return {"number": 0, "ts": 0, "files": {}, "digests": {}}
        with open(f"{self.listings}/{number}.json", encoding="utf-8") as file:
            return json.load(file)

    def _last(self) -> int:
        return max((int(x[:-5]) for x in os.listdir(self.listings) if re.fullmatch(r"\d+\.json", x)), default=0)

    def _list(self) -> int:
        """The number of a listing of the tree as it is: the last one's if nothing has changed since."""
        os.makedirs(self.listings, exist_ok=True)
        last = self._manifest(self._last())
        number = last["number"] + 1
        names = [f"{self.listings}/{number}-{b}" for b in range(self.buckets)]
        open_files, digests = [open(x, "w", encoding="utf-8") for x in names], [hashlib.sha256() for _ in names]
        used = set()
        for folder, files in _below(self.root):
            bucket = zlib.crc32(os.fsencode(os.path.relpath(folder, self.root))) % self.buckets
            for entry in files:
                try:
                    stat = entry.stat()
                except FileNotFoundError:
                    continue
                line = json.dumps([os.path.relpath(entry.path, self.root), stat.st_size, stat.st_mtime_ns]) + "\n"
                open_files[bucket].write(line)
                digests[bucket].update(line.encode())
                used.add(bucket)
        for file in open_files:
            file.close()
        now = {str(b): digests[b].hexdigest() for b in sorted(used)}
        kept = {b: last["files"][b] for b in now if last["digests"].get(b) == now[b]}
        for b, name in enumerate(names):
            if str(b) not in now or str(b) in kept:
                os.unlink(name)
        if now == last["digests"]:
            return last["number"]
        manifest = {"number": number, "ts": time.time_ns() // 1000, "files": {b: kept.get(b, number) for b in now}, "digests": now}
        with open(f"{self.listings}/{number}.part", "w", encoding="utf-8") as file:
            json.dump(manifest, file)
        os.replace(f"{self.listings}/{number}.part", f"{self.listings}/{number}.json")
        return number

    def initialOffset(self) -> dict:
        return {"listing": 0 if self.initial else self._list()}

    def latestOffset(self) -> dict:
        return {"listing": self._list()}

    def partitions(self, start: dict, end: dict) -> list[Bucket]:
        old, new = self._manifest(start["listing"]), self._manifest(end["listing"])
        changed = [b for b in sorted({*old["files"], *new["files"]}, key=int) if old["files"].get(b) != new["files"].get(b)]
        return [Bucket(int(b), old["files"].get(b), new["files"].get(b), new["number"], new["ts"]) for b in changed]

    def commit(self, end: dict) -> None:
        """Removes the listings before ``end``, and the files that neither it nor a later one counts."""
        numbers = [int(x[:-5]) for x in os.listdir(self.listings) if re.fullmatch(r"\d+\.json", x)]
        kept = [n for n in numbers if n >= end["listing"]]
        used = {f"{n}-{b}" for k in kept for b, n in self._manifest(k)["files"].items()}
        for name in os.listdir(self.listings):
            part = re.fullmatch(r"(\d+)-\d+", name)
            if part and int(part[1]) <= max(kept, default=0) and name not in used or name in {f"{n}.json" for n in numbers if n < end["listing"]}:
                os.unlink(f"{self.listings}/{name}")

    def _files(self, bucket: int, number: int | None) -> dict[str, list[int]]:
        if number is None:
            return {}
        with open(f"{self.listings}/{number}-{bucket}", encoding="utf-8") as file:
            return {path: rest for path, *rest in map(json.loads, file)}

    def read(self, part: Bucket) -> Iterator[tuple]:
        old, new = self._files(part.bucket, part.old), self._files(part.bucket, part.new)
        ts = dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=part.ts)
        differing = (path for path in sorted({*old, *new}) if old.get(path) != new.get(path))
        for i, path in enumerate(differing):
            seq = (part.listing << 38) + (part.bucket << 24) + i
            if path not in new:
                yield seq, ts, path, "unlink", None
                continue
            content = _content(os.path.join(self.root, path))
            if content is not None:  # one that has gone since is for a later listing
                yield seq, ts, path, "change" if path in old else "add", content


class SourceTree(DataSource):
    """``spark.dataSource.register(SourceTree)``, then ``format("source_tree")``: seq, ts, path, op, content of source files.

    Options: ``path``, the tree's root, which all machines see; ``partitions`` of a batch read (64). For a stream ``listings``, a shared
    folder that belongs to the stream like its checkpoint; ``buckets`` of folders (64), fixed for the stream's life, 16,384 at most; ``initial``
    (false) whether files that are there at the start are told as added. A file counts as changed when its size or time does.
    Edits between two listings are one change, a removal and a new file of one name between them too; contents are read when
    a task runs. Links to folders are not followed. ``seq`` orders the changes of one path, and one listing's before the next's.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FEED

    def _root(self) -> str:
        if not self.options.get("path"):
            raise ValueError("source_tree needs the option path")
        return self.options["path"].removeprefix("file://").rstrip("/") or "/"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self._root(), int(self.options.get("partitions", 64)))

    def streamReader(self, schema) -> TreeStream:
        if not self.options.get("listings"):
            raise ValueError("source_tree needs the option listings to stream")
        buckets = int(self.options.get("buckets", 64))
        if not 0 < buckets <= 1 << 14:
            raise ValueError("buckets has to be from 1 to 16384")
        return TreeStream(self._root(), self.options["listings"].removeprefix("file://"), buckets, str(self.options.get("initial", "false")).lower() == "true")
