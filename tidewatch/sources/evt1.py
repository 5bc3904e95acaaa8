"""Framed event logs as a data source of Spark's: ``spark.read.format("evt1")``, streams and a committing sink.

A record is the magic, its length (32 bits, little endian) and a JSON text. ``register(spark)`` first; then

- read: columns file, offset (the record's place, in bytes; of a compressed log, when unpacked) and value. Plain files
  are cut into ranges of ``splitBytes``; a range has the records that begin in it. Its first record is found by the magic
  and a length whose highest byte is 0: a NUL can't stand in JSON text, so this is a header and nothing else; a header
  of a longer record (16 MB and more) counts if another header, or the end, follows where it points. Each range also looks
  at what follows its last record, so damage at a cut is found as anywhere. Compressed logs, told by their first bytes,
  can't be cut; they are unpacked as a stream. Small files are read together. A record that is cut off by the file's
  end ends the file; bytes that are no header where one should be are an error, or with ``permissive`` the quiet end of
  the file, which then is read in one piece.
- readStream: offsets are the end of the last whole record of each file, found from the file's tail, so a record that
  is being written waits for the next batch. Files are appended to or added, not renamed.
- write and writeStream: column value. Each task writes files of ``maxBytes`` at most to a hidden folder of the job; the
  commit moves them to their names, so readers see all of a job or nothing, and what a lost task has left goes with
  the folder. ``compress``; ``maxFiles`` keeps that many files at most and deletes the oldest by name. A stream's files bear
  its batch's number: a batch that is written again replaces its own.

Paths are read by Arrow's file systems (local, HDFS, S3, GCS, by URI). Names that begin with a dot or an underscore are
not read.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC, GZIP, HEAD = b"EVT1", b"\x1f\x8b", 8
SCHEMA = "file string, offset long, value string"
BLOCK, BATCH = 1 << 20, 4096


def located(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, a folder or a pattern in the last part of the path, by name."""
    fs, at = located(path)
    folder, _, name = at.rstrip("/").rpartition("/")
    if any(c in name for c in "*?["):
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        found = [f for f in found if fnmatch.fnmatchcase(f.base_name, name)]
    else:
        info = fs.get_file_info(at.rstrip("/"))
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(info.path))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[:1] not in "._")


@dataclass
class Range(InputPartition):
    """Pieces of files (path, from, to); to is None for the file's end; ``exact`` if a record begins at from."""

    pieces: list
    permissive: bool
    exact: bool = False


def is_header(data: bytes, at: int) -> bool | None:
    """Whether these bytes begin a record for certain; None if only what follows it can tell."""
    if data[at : at + 4] != MAGIC or len(data) < at + HEAD:
        return False
    return True if data[at + 7] == 0 else None


def _leads(f: pa.NativeFile, at: int, size: int) -> bool:
    """Whether what follows a long record's place is a header, or the end of the file."""
    f.seek(at + 4)
    end = at + HEAD + struct.unpack("<I", f.read(4))[0]
    if end >= size:
        return end == size
    f.seek(end)
    return f.read(4) == MAGIC


def first_record(f: pa.NativeFile, at: int, end: int, size: int) -> int | None:
    """The first record that begins at or behind ``at`` and before ``end``."""
    while at < end:
        f.seek(at)
        data = f.read(BLOCK + HEAD)
        k = data.find(MAGIC)
        while 0 <= k < BLOCK and at + k < end:
            sure = is_header(data, k)
            if sure or (sure is None and _leads(f, at + k, size)):
                return at + k
            k = data.find(MAGIC, k + 1)
        at += BLOCK
    return None


class Records:
    """The records of an open log from a place on, read ahead in blocks."""

    def __init__(self, f: io.IOBase, at: int):
        self.f, self.at, self.held, self.k = f, at, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.k < n:
            more = self.f.read(max(BLOCK, n - len(self.held) + self.k))
            if not more:
                break
            self.held, self.k = self.held[self.k :] + more, 0
        return self.held[self.k : self.k + n]

    def next(self, permissive: bool) -> tuple[int, bytes] | None:
        head = self.take(HEAD)
        if head[:4] != MAGIC[: len(head)]:
            if permissive:
                return None
            raise ValueError(f"no record at byte {self.at}")
        if len(head) < HEAD:
            return None
        n = struct.unpack_from("<I", head, 4)[0]
        whole = self.take(HEAD + n)
        if len(whole) < HEAD + n:
            return None
        at = self.at
        self.at, self.k = self.at + HEAD + n, self.k + HEAD + n
        return at, whole[HEAD:]


def records(path: str, start: int, end: int | None, permissive: bool, exact: bool) -> Iterator[tuple[int, bytes]]:
    """The records that begin in this range of a file."""
    fs, _ = located(path)
    with fs.open_input_file(located(path)[1]) as f:
        size = f.size()
        if f.read(2) == GZIP:
            if start:
                return
            f.seek(0)
            log = Records(gzip.GzipFile(fileobj=f), 0)
            while (r := log.next(permissive)) is not None:
                yield r
            return
        end = size if end is None else end
        if start and not exact:
            start = first_record(f, start, end, size)
            if start is None:
                return
        f.seek(start)
        log = Records(f, start)
        while log.at < end:
            if (r := log.next(permissive)) is None:
                return
            yield r
        if not permissive and (after := log.take(4)) != MAGIC[: len(after)]:
            raise ValueError(f"no record at byte {log.at}")


def _batches(ranges: Range) -> Iterator[pa.RecordBatch]:
    for path, start, end in ranges.pieces:
        at, texts, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at, pa.int64()), pa.array(texts, pa.string())], names=["file", "offset", "value"])  # noqa: B023

        for place, payload in records(path, start, end, ranges.permissive, ranges.exact):
            at.append(place)
            texts.append(payload.decode("utf-8", "replace"))
            size += len(payload)
            if len(at) >= BATCH or size > 8 * BLOCK:
                yield batch()
                at, texts, size = [], [], 0
        if at:
            yield batch()


def cut(files: list[tuple[str, int, int]], split: int, permissive: bool, exact: bool) -> list[Range]:
    """Ranges of (file, from, to), small files together; a file counts for a 32nd of a split at least."""
    out, held, n = [], [], 0
    for path, start, end in files:
        step = max(split, 1)
        if end - start > step and not permissive:
            out += [Range([(path, a, min(end, a + step))], permissive, exact and a == start) for a in range(start, end, step)]
            continue
        if held and n + max(end - start, step // 32) > step:
            out.append(Range(held, permissive, exact))
            held, n = [], 0
        held.append((path, start, end))
        n += max(end - start, step // 32)
    return out + ([Range(held, permissive, exact)] if held else [])


class _Options:
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("evt1 needs a path")
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        self.path, self.permissive, self.compress = options["path"], flag("permissive"), flag("compress")
        self.split, self.most, self.files = int(options.get("splitBytes", 128 << 20)), int(options.get("maxBytes", 50 << 20)), int(options.get("maxFiles", 0))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)

    def partitions(self) -> list[Range]:
        return cut([(p, 0, n) for p, n in listed(self.o.path)], self.o.split, self.o.permissive, False) or [Range([], self.o.permissive)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition)


def complete(path: str, size: int, known: int) -> int:
    """The end of the last whole record within the file's first ``size`` bytes, of which ``known`` are known to be whole
    records; only the tail is read. A compressed log counts as a whole."""
    fs, at = located(path)
    with fs.open_input_file(at) as f:
        if f.read(2) == GZIP:
            return size
        back = BLOCK
        while True:
            start = max(known, size - back)
            at = known if start == known else first_record(f, start, size, size)
            if at is not None:
                f.seek(at)
                log, end = Records(f, at), at
                while log.at < size and log.next(True) is not None and log.at <= size:
                    end = log.at
                if end > at or start == known:
                    return end
            back *= 4


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.o, self.seen = _Options(options), {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        try:
            files = listed(self.o.path)
        except FileNotFoundError:
            files = []
        self.seen = {p: self.seen[p] if self.seen.get(p, 0) == n else complete(p, n, self.seen.get(p, 0)) for p, n in files}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        for p, n in end.items():
            self.seen[p] = max(n, self.seen.get(p, 0))
        return cut([(p, start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)], self.o.split, False, True) or [Range([], False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _batches(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list  # (hidden path, number within the task)
    task: int
    records: int


class _Files:
    """What batch and stream writers share."""

    def __init__(self, options: dict):
        self.o = _Options(options)
        self.job = uuid.uuid4().hex
        self.folder = located(self.o.path)[1].rstrip("/")
        self.hidden = f"{self.folder}/_job-{self.job}"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        fs, _ = located(self.o.path)
        fs.create_dir(self.hidden, recursive=True)
        c = TaskContext.get()
        task, stem = (c.partitionId(), f"{c.partitionId():05d}-{c.taskAttemptId()}") if c else (0, "00000-0")
        files, out, size, n = [], None, 0, 0
        try:
            for row in rows:
                payload = row["value"].encode()
                if out is not None and size + HEAD + len(payload) > self.o.most:
                    out.close()
                    out = None
                if out is None:
                    files.append(f"{self.hidden}/{stem}-{len(files):05d}")
                    raw = fs.open_output_stream(files[-1])
                    out, size = (pa.CompressedOutputStream(raw, "gzip") if self.o.compress else raw), 0
                out.write(MAGIC + struct.pack("<I", len(payload)) + payload)
                size, n = size + HEAD + len(payload), n + 1
        finally:
            if out is not None:
                out.close()
        return Written(files, task, n)

    def publish(self, messages: list, stem: str) -> None:
        fs, _ = located(self.o.path)
        fs.create_dir(self.folder, recursive=True)
        for old in fs.get_file_info(pafs.FileSelector(self.folder)):
            if old.base_name.startswith(stem):
                fs.delete_file(old.path)
        end = ".evt1.gz" if self.o.compress else ".evt1"
        for m in messages:
            for k, f in enumerate(m.files if m else []):
                fs.move(f, f"{self.folder}/{stem}{m.task:05d}-{k:05d}{end}")
        self.clear()
        if self.o.files > 0:
            for path, _ in listed(self.o.path)[: -self.o.files]:
                fs.delete_file(path)

    def clear(self) -> None:
        fs, _ = located(self.o.path)
        if fs.get_file_info(self.hidden).type == pafs.FileType.Directory:
            fs.delete_dir(self.hidden)


class Writer(_Files, DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options)
        self.overwrite = overwrite

    def commit(self, messages: list) -> None:
        if self.overwrite:
            fs, _ = located(self.o.path)
            for path, _ in listed(self.o.path):
                fs.delete_file(path)
        self.publish(messages, f"part-{time.time_ns():020d}-{self.job[:8]}-")

    def abort(self, messages: list) -> None:
        self.clear()


class StreamWriter(_Files, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.publish(messages, f"batch-{batchId:012d}-")

    def abort(self, messages: list, batchId: int) -> None:
        self.clear()


class Evt1(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evt1"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to this session. Workers get this module with the job."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Evt1)


def payloads(events: DataFrame) -> DataFrame:
    """What the sink takes: each row as JSON text."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n records of a log, its files by name."""
    return spark.read.format("evt1").option("permissive", "true").load(path).orderBy(F.desc("file"), F.desc("offset")).limit(n)

