"""A log whose files grow: a streaming source that keeps a byte offset for each file, and a writer that appends to such files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES = 16 << 20  # bytes of a file that one task reads
BACK = 1 << 16          # bytes read at a time in search of the last line's end
SCHEMA = "file string, position long, value string"


@dataclass
class Range(InputPartition):
    """Bytes of a file; a line belongs to the range in which it begins."""

    file: str
    start: int
    end: int


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def line_end(fs: pafs.FileSystem, file: str, size: int, known: int = 0) -> int:
    """Bytes up to the end of the last whole line, at least ``known``."""
    with fs.open_input_file(file) as f:
        end = size
        while end > known:
            start = max(known, end - BACK)
            at = f.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return known


class Ends:
    """Offsets of the last whole lines of a file, or of the files of a folder; a file is looked at again only if its size has changed."""

    def __init__(self, path: str):
        self.path = path
        self.seen: dict[str, tuple[int, int]] = {}

    def now(self) -> dict[str, int]:
        fs, path = open_path(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(path))
        else:
            found = [info]
        out = {}
        for x in found:
            if x.type != pafs.FileType.File or x.base_name.startswith((".", "_")):
                continue
            size, end = self.seen.get(x.path, (0, 0))
            if x.size != size:
                end = line_end(fs, x.path, x.size, end if x.size > size else 0)
                self.seen[x.path] = x.size, end
            out[x.path] = end
        return out


def ranges(start: dict[str, int], end: dict[str, int], step: int) -> Sequence[Range]:
    out = []
    for file, z in sorted(end.items()):
        a = start.get(file, 0)
        if z < a:
            raise ValueError(f"{file} is shorter than what was read of it: a log only grows")
        out += [Range(file, i, min(z, i + step)) for i in range(a, z, step)]
    return out


def read_range(path: str, r: Range) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range; the last one may end after it."""
    fs, _ = open_path(path)
    with fs.open_input_file(r.file) as f:
        size = f.size()
        data, start = f.read_at(r.end - r.start, r.start), r.start
        if r.start and f.read_at(1, r.start - 1) != b"\n":  # the range begins inside a line of the one before
            skip = data.find(b"\n") + 1
            data, start = (data[skip:], r.start + skip) if skip else (b"", r.end)
        if data and not data.endswith(b"\n"):
            at, rest = r.end, []
            while at < size:
                part = f.read_at(min(BACK, size - at), at)
                stop = part.find(b"\n")
                rest.append(part if stop < 0 else part[:stop + 1])
                if stop >= 0:
                    break
                at += len(part)
            data += b"".join(rest)
    lines = data.split(b"\n")[:-1]
    if not lines:
        return
    at = [start]
    for line in lines[:-1]:
        at.append(at[-1] + len(line) + 1)
    text = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
    yield pa.RecordBatch.from_arrays([pa.array([r.file] * len(text)), pa.array(at, pa.int64()), pa.array(text)], ["file", "position", "value"])


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.ends = Ends(self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.ends.now()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return ranges(start, end, self.step)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.path, partition)


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        return ranges({}, Ends(self.path).now(), self.step) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(self.path, partition) if partition.file else iter(())


class LogTail(DataSource):
    """Lines of a growing file, or of the growing files of a folder: ``file, position`` (byte) and ``value``.

    Every trigger reads what was appended since the last, in byte ranges (``rangeBytes``); a last line without its end waits until it has one.  The offsets
    of the checkpoint say what was read, so each line arrives once, also after a restart.  Files whose names begin with ``.`` or ``_`` are left out.  A file
    that became shorter is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "stripline_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)


def tail(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, streaming: bool = True) -> DataFrame:
    """The lines of a growing log, as a stream, or those that are there now."""
    spark.dataSource.register(LogTail)
    return (spark.readStream if streaming else spark.read).format(LogTail.name()).option("path", path).option("rangeBytes", range_bytes).load()


def append_lines(lines: DataFrame, folder: str, files: int, sizes: dict[str, int] | None = None) -> dict[str, int]:
    """Append the column ``value`` to the growing files of a folder that all executors mount, each file by one task; returns the files' sizes.

    ``sizes`` are those that the last call returned: a task first cuts its file back to that size, so one that runs again appends nothing twice.
    """
    import os

    sizes = dict(sizes or {})
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"{folder}/log-{batch.column(0)[0].as_py():05d}.jsonl"
                out = open(name, "r+b" if os.path.exists(name) else "w+b")  # noqa: SIM115
                out.truncate(sizes.get(name, 0))
                out.seek(0, os.SEEK_END)
            out.write(b"".join(v.encode() + b"\n" for v in batch.column(1).to_pylist()))
        if out is not None:
            end = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([end])], ["file", "size"])

    f = F.pmod(F.xxhash64("value"), F.lit(files)).cast("int")
    dealt = lines.select(f.alias("f"), "value").repartitionById(files, F.col("f"))
    return sizes | {r.file: r.size for r in dealt.mapInArrow(write, "file string, size long").collect()}
