"""``spark.read.format("gfa")``: the records of GFA files as a data source.

Rows: rec_no, record (the first character of the line, empty for an empty line) and line, which the functions of `gfa` take as they take the rows of
`gfa.read_lines`.  The option records (letters with commas) names those to read; no rows are made of other lines.  It is an option and no pushed filter, because Spark 4.1
keeps what it pushed to a source in Python with the table: two filters on one table in one plan both read the rows of the last (seen with a union).

rec_no is the number of the file, by path, and the place of the line's first byte in it: it grows in file order and tells rows apart, but is not dense, so nothing
has to be counted before the rows (`storage.numbered` makes it dense).  Files are read in ranges of bytes; a line belongs to the range in which it starts.

Paths are those that pyarrow reaches (local, hdfs, s3, gs); `gfa.read_lines` reads what Spark reaches.  Folders are taken without their subfolders and hidden
files.  A compressed file (gz, bz2, zst) is one range, and its places are those of the text.  An empty file or folder gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import gfa

SCHEMA = "rec_no long, record string, line string"
ARROW = pa.schema([("rec_no", pa.int64()), ("record", pa.string()), ("line", pa.string())])
#: Bytes of a range (option splitBytes), and of a read.
SPLIT, CHUNK = 128 << 20, 8 << 20
#: A place in a file has so many bits: files of up to 16 TiB, about 500,000 of them.
PLACE_BITS = 44
COMPRESSED = (".gz", ".bz2", ".zst")


@dataclass
class Range(InputPartition):
    file_no: int
    path: str
    start: int
    end: int


def files_of(paths: list[str]) -> list[tuple[str, int]]:
    """Path and size of the files that paths name, ordered by path within each."""
    found = []
    for path in paths:
        system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        held = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
        found += sorted((head + f.path, f.size) for f in held if f.type == fs.FileType.File and f.base_name[0] not in "._")
    return found


def opened(part: Range) -> Callable[[int], bytes]:
    """A function that reads the next bytes of a range; a range that starts inside a file begins one byte early."""
    system, inner = fs.FileSystem.from_uri(part.path) if "://" in part.path or part.path.startswith("file:") else (fs.LocalFileSystem(), part.path)
    if part.path.endswith(COMPRESSED):
        return system.open_input_stream(inner).read  # the suffix tells how
    file = system.open_input_file(inner)
    file.seek(max(part.start - 1, 0))
    return file.read


def whole_lines(read: Callable[[int], bytes], start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and text of runs of whole lines, each with its line feed, from the first line that starts in a range to the last."""
    at, held, ended = start, [], False
    if start:  # what lies before the first line feed belongs to the range before, and may be longer than this range
        at = start - 1
        while True:
            chunk = read(CHUNK)
            feed = chunk.find(b"\n")
            at += len(chunk) if feed < 0 else feed + 1
            if at >= end or not chunk:
                return
            if feed >= 0:
                held = [chunk[feed + 1 :]]
                break
    while at < end and not ended:
        chunk = read(CHUNK)
        ended = not chunk
        held.append(chunk)
        if not ended and b"\n" not in chunk:
            continue  # a long line goes on
        text = b"".join(held)
        if ended and text and not text.endswith(b"\n"):
            text += b"\n"
        cut = text.rfind(b"\n") + 1
        held = [text[cut:]]
        if cut:
            yield at, text[:cut]
        at += cut


def batch(first: int, at: int, text: bytes, end: int, records: list[str]) -> pa.RecordBatch:
    """The rows of a run of whole lines; those of other records, and of lines that start after the range, are left out before they are made."""
    data = np.frombuffer(text, np.uint8)
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], feeds[:-1] + 1])
    keep = starts + at < end
    if records:
        keep &= np.isin(data[starts], [ord(r) for r in records])
    offsets = np.concatenate([starts, [len(data)]]).astype(np.int32)
    lines = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text)]).filter(pa.array(keep))
    lines = pc.replace_substring_regex(lines, r"\r?\n$", "").cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(first + at + starts[keep]), pc.utf8_slice_codeunits(lines, 0, 1), lines], schema=ARROW)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.size = int(options.get("splitBytes", SPLIT))
        self.records = [r.strip() for r in options.get("records", "").split(",") if r.strip()]
        if any(len(r) > 1 or not r.isascii() for r in self.records):
            raise ValueError("records are single letters")

    def partitions(self) -> list[Range]:
        parts = []
        for k, (path, size) in enumerate(files_of(self.paths)):
            if k >= 1 << (63 - PLACE_BITS):
                raise ValueError("too many files for one table")
            if path.endswith(COMPRESSED):
                parts.append(Range(k, path, 0, 1 << PLACE_BITS))
            else:
                parts += [Range(k, path, at, min(at + self.size, size)) for at in range(0, size, self.size)]
        return parts or [Range(0, "", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            for at, text in whole_lines(opened(part), part.start, part.end):
                yield batch(part.file_no << PLACE_BITS, at, text, part.end, self.records)


class GfaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gfa"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("gfa") known to a session."""
    spark.dataSource.register(GfaSource)


def lines(spark: SparkSession, *paths: str, records: str = "") -> DataFrame:
    register(spark)
    return spark.read.format("gfa").option("records", records).load(list(paths) if len(paths) > 1 else paths[0])


def load(spark: SparkSession, *paths: str) -> gfa.Graph:
    """The tables of GFA files, each by a scan of its own records; malformed ones end the job."""

    def of(records: str) -> DataFrame:
        return gfa.checked(lines(spark, *paths, records=records))

    return gfa.Graph(gfa.segments(of("S")), gfa.links(of("L,E")), gfa.paths(of("P")), gfa.walks(of("W")))
