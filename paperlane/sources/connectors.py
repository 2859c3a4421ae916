"""Data sources for spark.read and spark.readStream: archives of sources, and matrices in the .npy format.

`spark.read.format("source_archives").load(folder)` unpacks every file of a folder, several small ones to a partition; the same format as a stream takes files up as they
appear. `spark.read.format("npy_matrix").load(file)` reads the rows of a matrix, each partition its own range of bytes. Files are opened by pyarrow's file systems, on the executors.
"""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from paperlane.sources.files import members

#: Bytes of a partition, unless the option partitionBytes says otherwise.
PARTITION_BYTES = 64 << 20
#: Rows of a matrix that are sent at a time.
ROWS = 4096
ARCHIVES = "paper_id string, path string, content string, error string"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, from a path or an address."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def listed(uri: str) -> list[tuple[int, str, int]]:
    """(time of change in ns, path, bytes) of the files in a folder (or of the one file), in order; hidden ones are passed over."""
    system, path = opened(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in files if f.type == fs.FileType.File and f.base_name[:1] not in "._")


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Rows(InputPartition):
    low: int
    high: int


def packed(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Files in order, to partitions of about `most` bytes."""
    out, size = [], 0
    for _, path, n in files:
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(path)
        size += n
    return [Files(tuple(p)) for p in out]


def unpacked(uri: str, paths: tuple[str, ...]) -> Iterator[tuple]:
    """The files of each source; a paper's id is the file's name without its last ending. A source's failure is a row."""
    system, _ = opened(uri)
    for path in paths:
        paper = path.rpartition("/")[2]
        paper = paper[: -len(".tar.gz")] if paper.endswith(".tar.gz") else paper.rpartition(".")[0] or paper
        try:
            with system.open_input_file(path) as file:
                rows = [(paper, name, data.decode("utf-8", "replace"), None) for name, data in members(file.read())]
        except Exception as e:  # one source's failure is data
            rows = [(paper, None, None, f"{type(e).__name__}: {e}")]
        yield from rows


class SourceArchives(DataSource):
    """Options: path, and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "source_archives"

    def schema(self) -> str:
        return ARCHIVES

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArchiveStream(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        return packed(listed(self.uri), self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return unpacked(self.uri, partition.paths)


class ArchiveStream(DataSourceStreamReader):
    """An offset is the last file taken up, by time of change and path; what a batch reads is fixed by its two offsets."""

    def __init__(self, options):
        self.uri, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = listed(self.uri)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, to = (start["time"], start["path"]), (end["time"], end["path"])
        return packed([f for f in listed(self.uri) if after < f[:2] <= to], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return unpacked(self.uri, partition.paths)


@dataclass(frozen=True)
class Header:
    """Where a matrix's rows begin, its type and shape."""

    at: int
    dtype: str
    shape: tuple[int, int]

    @classmethod
    def read(cls, uri: str) -> Header:
        system, path = opened(uri)
        with system.open_input_file(path) as file:
            magic = file.read(8)
            if magic[:6] != b"\x93NUMPY":
                raise ValueError(f"{uri} is no .npy file")
            wide = magic[6] > 1
            size = struct.unpack("<I" if wide else "<H", file.read(4 if wide else 2))[0]
            of = ast.literal_eval(file.read(size).decode("utf-8" if magic[6] > 2 else "latin-1"))
            at, dtype = file.tell(), np.dtype(of["descr"])
            if of["fortran_order"] or len(of["shape"]) != 2 or dtype.kind != "f":
                raise ValueError(f"{uri} is no matrix of floats, row by row")
            if file.size() != at + of["shape"][0] * of["shape"][1] * dtype.itemsize:
                raise ValueError(f"{uri} has {file.size()} bytes, its header tells of {of['shape'][0]} rows of {of['shape'][1]}")
        return cls(at, dtype.str, tuple(of["shape"]))


class NpyMatrix(DataSource):
    """row_index and embedding of every row. Options: path, and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "row_index long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options)


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.most, self.header = options["path"], int(options.get("partitionBytes", PARTITION_BYTES)), Header.read(options["path"])

    def partitions(self) -> list[Rows]:
        n, width = self.header.shape
        step = max(1, self.most // max(1, width * np.dtype(self.header.dtype).itemsize))
        return [Rows(low, min(low + step, n)) for low in range(0, n, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        width, dtype = self.header.shape[1], np.dtype(self.header.dtype)
        system, path = opened(self.uri)
        with system.open_input_file(path) as file:
            for low in range(partition.low, partition.high, ROWS):
                n = min(ROWS, partition.high - low)
                file.seek(self.header.at + low * width * dtype.itemsize)
                m = np.frombuffer(file.read(n * width * dtype.itemsize), dtype).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(m))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + n)), vectors], ["row_index", "embedding"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceArchives)
    spark.dataSource.register(NpyMatrix)


def read_matrix_rows(spark: SparkSession, folder: str, schema: str, matrix: str = "embeddings.npy", rows: str = "rows.jsonl", config: str = "config.json") -> DataFrame:
    """The rows of rows.jsonl (with row_index) with their vectors. Rows and matrix must be aligned: as many of each, every index once; config.json, if it tells of them, must agree."""
    register(spark)
    shape = Header.read(f"{folder}/{matrix}").shape
    system, path = opened(f"{folder}/{config}")
    if system.get_file_info(path).type == fs.FileType.File:
        with system.open_input_file(path) as file:
            told = json.loads(file.read())
        if (told.get("count", shape[0]), told.get("dimension", shape[1])) != shape:
            raise ValueError(f"{config} tells of {told.get('count')} rows of {told.get('dimension')}, {matrix} holds {shape[0]} of {shape[1]}")
    kept = spark.read.schema(schema).json(f"{folder}/{rows}")
    n, distinct, low, high = kept.agg(F.count("*"), F.count_distinct("row_index"), F.min("row_index"), F.max("row_index")).first()
    if n != shape[0] or distinct != n or n and (low, high) != (0, n - 1):
        raise ValueError(f"{rows} has {n} rows with {distinct} indices, {matrix} has {shape[0]} rows")
    return kept.join(spark.read.format("npy_matrix").load(f"{folder}/{matrix}"), "row_index")
