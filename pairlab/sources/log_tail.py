"""A streaming source of growing text files that remembers byte offsets.

Spark's file streams read a file once, when it appears. This source keeps how far
each file has been read, so that a trigger reads only what has come since, whether in
a new file or at the end of a known one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "log_tail"
SCHEMA = "value string, run_name string, file string, start bigint"
#: Bytes that one task reads, and that a trigger reads from one file's end to find its
#: last whole line.
TASK_BYTES, BLOCK_BYTES = 32 * 1024**2, 64 * 1024


@dataclass
class Ranges(InputPartition):
    """Byte ranges (file, start, end, first, last) of a task. ``first`` and ``last``
    are the file's new part, whose edges are edges of lines."""

    parts: Sequence[tuple[str, int, int, int, int]]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").load(folder)``: the lines of all files
    below ``folder`` as they are written, with the name of the file's folder, the file
    and the line's byte offset.

    Options: ``unfinished`` says what becomes of a last line without an end. ``wait``
    (the default) leaves it until its end is there; ``read`` takes it as it is, and
    what is added to it later is a line of its own. A file that has become shorter was
    written anew and is read from its start.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogTailReader:  # noqa: N802 - Spark's name
        wait = str(self.options.get("unfinished", "wait")).lower() != "read"
        return LogTailReader(self.options["path"], wait)


class LogTailReader(DataSourceStreamReader):
    """Offsets are a map of file to the number of its bytes read: one small entry per
    log file. Listing looks at sizes; of a file that has grown only the last block is
    read ahead, back to its last line end."""

    def __init__(self, path: str, wait: bool) -> None:
        self.path, self.wait = path, wait
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        ends = {}
        for info in found:
            hidden = info.base_name.startswith((".", "_"))
            if info.type != fs.FileType.File or hidden:
                continue
            size, end = self.known.get(info.path, (-1, 0))
            if info.size != size:
                end = info.size
                if self.wait:
                    end = _last_line_end(store, info.path, info.size)
                self.known[info.path] = info.size, end
            if end:
                ends[info.path] = end
        return ends

    def partitions(self, start: dict, end: dict) -> Sequence[Ranges]:
        made, held, room = [], [], TASK_BYTES
        for file, last in sorted(end.items()):
            first = start.get(file, 0)
            first = 0 if first > last else first
            at = first
            while at < last:
                stop = min(last, at + room)
                held.append((file, at, stop, first, last))
                room -= stop - at
                at = stop
                if not room:
                    made.append(Ranges(held))
                    held, room = [], TASK_BYTES
        return [*made, Ranges(held)] if held else made

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for file, start, stop, first, last in partition.parts:
            with store.open_input_file(file) as data:
                for lines, places in _lines(data, start, stop, first, last):
                    parts = file.split("/")
                    count = len(lines)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(lines, pa.string()),
                            pa.array([parts[-2] if len(parts) > 1 else ""] * count),
                            pa.array([file] * count),
                            pa.array(places, pa.int64()),
                        ],
                        ["value", "run_name", "file", "start"],
                    )

    def commit(self, end: dict) -> None:
        """Nothing to forget: the checkpoint holds the offsets."""


def _last_line_end(store: fs.FileSystem, file: str, size: int) -> int:
    """Bytes of the file up to its last line end, found from behind."""
    with store.open_input_file(file) as data:
        end = size
        while end > 0:
            start = max(0, end - BLOCK_BYTES)
            at = data.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def _lines(
    data, start: int, stop: int, first: int, last: int
) -> Iterator[tuple[list[str], list[int]]]:
    """Lines that begin in [start, stop), the last of them to its end; a range that
    begins inside a line leaves it to the range before."""
    at, rest = start, b""
    skipping = start > first and data.read_at(1, start - 1) != b"\n"
    while at < last:
        block = data.read_at(min(1 << 20, last - at), at)
        if not block:
            break
        begin = at - len(rest)
        at += len(block)
        pieces = (rest + block).split(b"\n")
        rest = pieces.pop() if at < last else b""
        # At the new part's end a line may lack its own.
        tail = pieces.pop() if at >= last else None
        lines, places = [], []
        for piece in pieces:
            if skipping:
                skipping = False
            elif begin < stop:
                lines.append(piece.decode("utf-8", "replace"))
                places.append(begin)
            begin += len(piece) + 1
        if tail and not skipping and begin < stop:
            lines.append(tail.decode("utf-8", "replace"))
            places.append(begin)
        if lines:
            yield lines, places
        if begin >= stop:
            return


def register(spark) -> None:
    """Make the source known to the session; doing it again changes nothing."""
    spark.dataSource.register(LogTail)
