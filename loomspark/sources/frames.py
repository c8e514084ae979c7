"""Line frames as a data source: ``spark.read.format("frames")`` and ``spark.readStream.format("frames")``.

A frame is a line; the row says where it starts, how long it is and what it holds: a request (an
object with id and method), a notification (a method without id), or why it holds nothing: oversize
(more than ``maxFrameBytes``, 4 MiB unless set, of which no byte is kept) or malformed (no JSON
object, no method, another protocol version, an id that is no string or integer).

Files are split into byte ranges; a range serves the frames that start in it, so that tasks need
nothing from each other and hold one frame.  A batch takes a last line without its end; a stream
leaves it until it is ended, and its offsets are the ends of whole frames by file.
Options: ``path`` (a file or folder, any URI that pyarrow opens), ``maxFrameBytes``, ``splitBytes``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, offset long, size long, kind string, id string, method string, json string"
MAX_FRAME_BYTES, SPLIT_BYTES, BLOCK = 4 << 20, 64 << 20, 1 << 16


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    to: int  # bytes of the file that count


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files, in order."""
    from pyarrow import fs

    system, at = _filesystem(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)


def parse_frame(frame: bytes) -> tuple[str, str | None, str | None, str | None]:
    """(kind, id as JSON, method, the frame as text)."""
    try:
        text = frame.decode("utf-8")
        value = json.loads(text)
    except (UnicodeDecodeError, ValueError, RecursionError):
        return "malformed", None, None, None
    if not isinstance(value, dict) or not isinstance(value.get("method"), str) or value.get("jsonrpc") != "2.0":
        return "malformed", None, None, None
    if "id" not in value:
        return "notification", None, value["method"], text
    if isinstance(value["id"], bool) or not isinstance(value["id"], (str, int)):
        return "malformed", None, None, None
    return "request", json.dumps(value["id"]), value["method"], text


def frames(stream, start: int, end: int, to: int, most: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, size, bytes or None if oversize) of the frames that start in [start, end)."""
    at = start
    if start:  # the first frame of the range starts behind the first line end at or after start - 1
        at = start - 1
        stream.seek(at)
        while block := stream.read(min(BLOCK, to - at)):
            found = block.find(b"\n")
            if found >= 0:
                at += found + 1
                break
            at += len(block)
        else:
            return
    stream.seek(at)
    held, size, offset = bytearray(), 0, at
    while offset < end and (block := stream.read(min(BLOCK, to - at))):
        at += len(block)
        lines = block.split(b"\n")
        for n, part in enumerate(lines):
            size += len(part)
            if size <= most:
                held += part
            else:
                held.clear()
            if n < len(lines) - 1:
                if offset < end:
                    yield offset, size, bytes(held) if size <= most else None
                offset, size = offset + size + 1, 0
                held.clear()
    if size and offset < end:
        yield offset, size, bytes(held) if size <= most else None


class _Reader:
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most = int(options.get("maxframebytes", MAX_FRAME_BYTES))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def ranges(self, path: str, start: int, to: int) -> list[ByteRange]:
        return [ByteRange(path, a, min(a + self.split, to), to) for a in range(start, to, self.split)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        system, _ = _filesystem(self.path)
        with system.open_input_file(partition.path) as stream:
            for offset, size, frame in frames(stream, partition.start, partition.end, partition.to, self.most):
                kind, ident, method, text = ("oversize", None, None, None) if frame is None else parse_frame(frame)
                yield partition.path, offset, size, kind, ident, method, text


class FrameReader(_Reader, DataSourceReader):
    def partitions(self) -> list[ByteRange]:
        return [r for path, size in _files(self.path) for r in self.ranges(path, 0, size)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        return _Reader.read(self, partition) if partition.path else iter(())


class FrameStreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """By file, the end of its last whole frame."""
        system, _ = _filesystem(self.path)
        out = {}
        for path, size in _files(self.path):
            at = size
            with system.open_input_file(path) as stream:
                while at:
                    low = max(0, at - BLOCK)
                    stream.seek(low)
                    found = stream.read(at - low).rfind(b"\n")
                    at = low + found + 1 if found >= 0 else low
                    if found >= 0:
                        break
            if at:
                out[path] = at
        return out

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return [r for path, to in sorted(end.items()) for r in self.ranges(path, start.get(path, 0), to)]

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FrameStreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark) -> None:
    spark.dataSource.register(FrameSource)
