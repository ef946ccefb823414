"""A tree of source files as a data source: batch and stream reader, and writer.

    spark.dataSource.register(SourceTree)
    spark.read.format("source_tree").option("ignore", ".min*").load("hdfs:///src")

Rows are path (below the root, with /), size, modified and content (UTF-8, what is invalid replaced). Folders of
``code.SKIP_DIRS`` are not entered; files whose base name holds a stripped pattern of ``ignore`` (separated by commas) are left out, and
so is what can't be read. Rows of a task are sorted by path.

Scale: the driver lists folders level by level until it has ``splits`` of them (64), and keeps no file; each task walks its own
folder. A folder that the driver opened is read by a task for each ``FILES`` of its files, dealt by name. Batches hold about
``BATCH_BYTES`` of content; a file is a row, so its content is at most what a string may hold (2 GB).

Streams return files by time of change: those changed after the last offset and up to ``settle`` seconds (2) before the
listing, so a file must carry its time of change when it appears. A batch that is repeated after a failure asks for the same times.
The writer creates or replaces the files of the given paths; a repeated task writes the same files again.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.code import SKIP_DIRS

FILES, BATCH_BYTES = 10_000, 16 << 20
SCHEMA = "path string, size long, modified timestamp, content string"
ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.string())])


@dataclass
class Folder(InputPartition):
    """A folder's own files (those of one slice by name), or all below it."""

    where: str
    whole: bool
    part: int = 0
    parts: int = 1
    after: int = -1
    upto: int | None = None


class _Tree:
    def __init__(self, options):
        if not options.get("path"):
            raise ValueError("source_tree needs a path")
        self.root, self.splits = options["path"], int(options.get("splits", 64))
        globs = [g.rstrip("*").rstrip("/") for g in (options.get("ignore") or "").split(",") if g]
        self.patterns = globs

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.root)
        return system, base.rstrip("/")

    @staticmethod
    def _list(system: fs.FileSystem, where: str) -> tuple[list[str], list[fs.FileInfo]]:
        """Folders to enter and files; an unreadable folder is empty, the root's absence an error."""
        try:
            found = system.get_file_info(fs.FileSelector(where, recursive=False, allow_not_found=True))
        except OSError:
            found = []
        found = sorted(found, key=lambda i: i.base_name)
        return [i.path for i in found if i.type == fs.FileType.Directory and i.base_name not in SKIP_DIRS], [i for i in found if i.type == fs.FileType.File]

    def folders(self, after: int = -1, upto: int | None = None) -> list[Folder]:
        system, base = self._open()
        if system.get_file_info(base or "/").type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        out, level = [], [base]
        while level and len(level) < self.splits:
            below = []
            for where in level:
                inner, files = self._list(system, where)
                parts = -(-len(files) // FILES)
                out += [Folder(where, False, k, parts, after, upto) for k in range(parts)]
                below += inner
            level = below
        return out + [Folder(where, True, 0, 1, after, upto) for where in level]

    def _files(self, system: fs.FileSystem, f: Folder) -> Iterator[fs.FileInfo]:
        todo = [f.where]
        while todo:
            inner, files = self._list(system, todo.pop())
            for i in files:
                changed = (i.mtime_ns or 0) // 1000
                mine = f.parts == 1 or zlib.crc32(i.base_name.encode("utf-8", "surrogateescape")) % f.parts == f.part
                if mine and changed > f.after and (f.upto is None or changed <= f.upto) and not any(p in i.base_name for p in self.patterns):
                    yield i
            if f.whole:
                todo += reversed(inner)

    def rows(self, f: Folder) -> Iterator[pa.RecordBatch]:
        system, base = self._open()
        some, held = [], 0
        for i in self._files(system, f):
            try:
                with system.open_input_stream(i.path) as stream:
                    body = stream.read()
            except OSError:
                continue
            some.append((i.path[len(base) + 1 :], len(body), (i.mtime_ns or 0) // 1000, body.decode("utf-8", "replace")))
            held += len(body)
            if held >= BATCH_BYTES or len(some) >= FILES:
                yield _batch(some)
                some, held = [], 0
        if some:
            yield _batch(some)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class TreeReader(_Tree, DataSourceReader):
    def partitions(self):
        return self.folders()

    def read(self, partition):
        return self.rows(partition)


class TreeStreamReader(_Tree, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.settle = float(options.get("settle", 2))

    def initialOffset(self):
        return {"upto": -1}

    def latestOffset(self):
        return {"upto": int((time.time() - self.settle) * 1e6)}

    def partitions(self, start, end):
        return self.folders(start["upto"], end["upto"])

    def read(self, partition):
        return self.rows(partition)


class TreeWriter(_Tree, DataSourceWriter):
    def write(self, iterator):
        system, base = self._open()
        made: set[str] = set()
        for row in iterator:
            steps = row["path"].split("/")
            if "" in steps or "." in steps or ".." in steps:
                raise ValueError(f"not a path below the root: {row['path']}")
            folder = "/".join([base, *steps[:-1]])
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made = made | {folder} if len(made) < FILES else {folder}
            with system.open_output_stream(f"{base}/{row['path']}") as out:
                out.write((row["content"] or "").encode("utf-8"))
        return WriterCommitMessage()


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)

    def streamReader(self, schema):
        return TreeStreamReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("source_tree replaces single files: use mode append")
        return TreeWriter(self.options)
