"""Data sources of article files and CoNLL files: ``spark.read.format("articles")``, ``spark.read.format("conll")``, and writers.

    register(spark)
    spark.read.format("articles").load(path)          # file, at, xml
    spark.read.format("conll").load(path)             # file, at, doc_id, row_idx, cols
    lines.write.format("articles").mode("append").save(path)   # value, an article element each
    lines.write.format("conll").mode("append").save(path)      # value, a document each

Files are read in splits of ``split`` bytes (64 MB). A split has the documents that begin in it and reads on to the end of the last
one, so a single huge file is the work of many tasks, and none holds more than a block and one article. A task reads several small
splits one after the other if there are very many. ``at`` is the byte at
which a document begins; with ``file`` it gives the order of documents.

A task writes its rows to a file of its own attempt in a folder that only the commit empties: it moves the files of the
attempts that Spark took, in the order of partitions, so a repeated or lost task leaves nothing behind. Each file has the head and
foot of its format and can be read alone; a table without rows gives one file with these. Nothing is sorted; a frame that is in order
stays so. Paths are what pyarrow's file systems can open: plain paths, file:, hdfs: or s3: addresses.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes that are read at a time.
BLOCK = 1 << 20
SPLIT = 64 << 20
#: Small splits of large files are dealt out to about so many tasks, of at most ``SPLIT`` bytes each.
TASKS = 256
HEAD, FOOT = "<?xml version='1.0' encoding='UTF-8' ?>\n<articles>\n", "</articles>\n"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass
class Split(InputPartition):
    """Documents of a file that begin from one byte up to another."""

    path: str
    first: int
    last: int


@dataclass
class Splits(InputPartition):
    """Splits that one task reads one after the other."""

    splits: list[Split]


def dealt(splits: list[Split], size: int) -> list[Splits]:
    """Splits in their order, so many for each task that it has ``size`` bytes at least, or as many as make ``TASKS`` tasks of all."""
    size = max(size, min(SPLIT, sum(s.last - s.first for s in splits) // TASKS))
    out, n = [], size
    for s in splits:
        if n >= size:
            out.append(Splits([]))
            n = 0
        out[-1].splits.append(s)
        n += s.last - s.first
    return out


class _Bytes:
    """A window on a file from a byte on, which is read as it is needed and forgotten as it is used."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, bytearray()
        file.seek(at)

    def more(self) -> bool:
        new = self.file.read(BLOCK)
        self.data += new
        return bool(new)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n

    def find(self, what: re.Pattern, longest: int, limit: int | None = None):
        """The first match, at a byte before ``limit`` if that is given; what can't be part of one is dropped on the way."""
        while True:
            m = what.search(self.data)
            if m and (m.end() < len(self.data) or not self.more()):
                return m if limit is None or self.at + m.start() < limit else None
            if m:
                continue
            if limit is not None and self.at + len(self.data) - longest >= limit:
                return None
            self.drop(max(0, len(self.data) - longest))
            if not self.more():
                return None

    def through(self, what: bytes) -> tuple[bytes, bool]:
        """All bytes up to the end of the next ``what``, or of the file, and whether it is there."""
        seen = 0
        while (found := self.data.find(what, seen)) < 0:
            seen = max(0, len(self.data) - len(what) + 1)
            if not self.more():
                out = bytes(self.data)
                self.drop(len(out))
                return out, False
        out = bytes(self.data[: found + len(what)])
        self.drop(len(out))
        return out, True


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.glob = options["path"], int(options.get("split", SPLIT)), options.get("pathglobfilter", options.get("pathGlobFilter", "*"))

    def partitions(self) -> list[Splits]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and not re.search(r"(^|/)[._]", x.path[len(path) :]) and fnmatch.fnmatch(x.base_name, self.glob))
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        return dealt([Split(prefix + p, a, min(a + self.split, n)) for p, n in names for a in range(0, n, self.split)], self.split) or [Splits([])]

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        for split in partition.splits:
            system, path = opened(split.path)
            with system.open_input_file(path) as file:
                rows, size = [], 0
                for row, n in self.rows(file, split):
                    rows.append(row)
                    size += n
                    if size >= BLOCK or len(rows) >= 10_000:
                        yield self.batch(rows, split.path)
                        rows, size = [], 0
                if rows:
                    yield self.batch(rows, split.path)


class _ArticleReader(_Reader):
    _BEGIN = re.compile(rb"<article(?=[\s>])")

    def rows(self, file, split):
        data = _Bytes(file, split.first)
        while m := data.find(self._BEGIN, len(b"<article") + 1, split.last):
            data.drop(m.start())
            at = data.at
            xml, _ = data.through(b"</article>")
            yield (at, xml.decode("utf-8", "replace")), len(xml)

    def batch(self, rows, path):
        at, xml = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(at, pa.int64()), pa.array(xml, pa.string())], names=["file", "at", "xml"])


class _ConllReader(_Reader):
    """Rows between #begin document and #end document; other lines that begin with # are skipped, and a begin ends the document before it."""

    _BEGIN = re.compile(rb"(?m)^#begin document")

    def rows(self, file, split):
        # one byte earlier, to see whether the first one begins a line
        data = _Bytes(file, max(0, split.first - 1))
        if split.first:
            data.more()
            if data.data[:1] != b"\n":
                data.through(b"\n")
            else:
                data.drop(1)
        while m := data.find(self._BEGIN, 0 if not data.data else len(b"\n#begin document"), split.last):
            data.drop(m.start())
            at, doc_id, n = data.at, None, 0
            while True:
                if doc_id is not None and self._next_begins(data):
                    break
                line, whole = data.through(b"\n")
                text = line.decode("utf-8", "replace").rstrip("\n")
                if doc_id is None:
                    doc_id = text[len("#begin document") + 1 :]
                elif text.startswith("#end document"):
                    break
                elif not text.startswith("#") and (whole or text):
                    yield (at, doc_id, n, [] if text == "" else re.split(r"\s+", text)), len(line)
                    n += 1
                if not whole:
                    break

    def _next_begins(self, data: _Bytes) -> bool:
        mark = b"#begin document"
        while len(data.data) < len(mark) and data.more():
            pass
        return data.data.startswith(mark)

    def batch(self, rows, path):
        at, ids, idx, cols = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(at, pa.int64()), pa.array(ids, pa.string()), pa.array(idx, pa.int32()), pa.array(cols, pa.list_(pa.string()))], names=["file", "at", "doc_id", "row_idx", "cols"])


@dataclass
class Written(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, head: str, foot: str, overwrite: bool):
        self.path, self.suffix, self.head, self.foot, self.overwrite = path, suffix, head, foot, overwrite
        self.job = uuid.uuid4().hex

    def _folder(self, path: str) -> str:
        return f"{path.rstrip('/')}/_writing-{self.job}"

    def write(self, batches) -> Written:
        """The texts of batches, or of rows one by one."""
        context = TaskContext.get()
        system, path = opened(self.path)
        folder = self._folder(path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        n = 0
        with system.open_output_stream(name) as out:
            for b in batches:
                for x in b.column(0) if isinstance(b, pa.RecordBatch) else pa.array(b[:1], pa.string()):
                    if (text := x.as_buffer()) is not None:
                        if not n:
                            out.write(self.head.encode())
                        out.write(text)
                        out.write(b"\n")
                        n += 1
            if n:
                out.write(self.foot.encode())
        return Written(context.partitionId(), name, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if x.type == fs.FileType.File and x.base_name.startswith("part-"):
                    system.delete_file(x.path)
        system.create_dir(path, recursive=True)
        taken = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        stem = f"{path.rstrip('/')}/part-{self.job}-"
        for i, m in enumerate(taken):
            system.move(m.path, f"{stem}{i:0{max(5, len(str(len(taken))))}}.{self.suffix}")
        if not taken:
            with system.open_output_stream(f"{stem}00000.{self.suffix}") as out:
                out.write((self.head + self.foot).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, path = opened(self.path)
        if system.get_file_info(folder := self._folder(path)).type == fs.FileType.Directory:
            system.delete_dir(folder)


class ArticleFiles(DataSource):
    """Files of article elements."""

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return "file string, at long, xml string"

    def reader(self, schema) -> _ArticleReader:
        return _ArticleReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], "xml", HEAD, FOOT, overwrite)


class ConllFiles(DataSource):
    """Files of CoNLL documents."""

    @classmethod
    def name(cls) -> str:
        return "conll"

    def schema(self) -> str:
        return "file string, at long, doc_id string, row_idx int, cols array<string>"

    def reader(self, schema) -> _ConllReader:
        return _ConllReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], "conll", "", "", overwrite)


def register(spark: SparkSession) -> None:
    for source in (ArticleFiles, ConllFiles):
        spark.dataSource.register(source)


def read(spark: SparkSession, source: str, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format(source).options(**options).load(path)


def write(lines: DataFrame, source: str, path: str, mode: str = "append") -> None:
    """The texts of ``value``, a line each or more, in the order of the frame."""
    register(lines.sparkSession)
    lines.select("value").write.format(source).mode(mode).save(path)
