"""Numeric ``.npy`` arrays as a Spark data source that is read by row ranges and written by file.

Reading plans tasks from the files' lengths alone: a large array is cut into byte ranges, small ones share a task.
A task reads the header of its file, turns its range into rows (a row belongs to the range its first byte
lies in) and reads only those, only the named columns. Conditions on ``file`` and ``row`` are pushed
down: files that do not match get no task, rows that do not match are not read.

Writing takes rows of (file, row, columns...) that are dealt by file and sorted by (file, row). Every attempt
writes under a name of its own, and only the commit of the job moves finished files into place, so that a retry or a
lost task leaves nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

FORMAT = "scanflow_arrays"
TASK_BYTES = 32 << 20
BATCH_ROWS = 65_536
_MOST = (1 << 63) - 1


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a plain path or a URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


class ArrayHeader:
    """Shape, type and place of the data of an open ``.npy`` file."""

    def __init__(self, source):
        version = np.lib.format.read_magic(source)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"unsupported array version {version}")
        shape, self.by_column, self.dtype = read(source)
        if self.dtype.kind not in "biuf" or len(shape) not in (1, 2):
            raise ValueError(f"not a numeric array of one or two dimensions: {shape} {self.dtype}")
        self.rows, self.columns = shape[0], shape[1] if len(shape) == 2 else 1
        self.begin = source.tell()
        self.width = self.columns * self.dtype.itemsize

    def rows_of(self, low: int, high: int) -> tuple[int, int]:
        """Rows whose first byte lies in [low, high) of the file."""
        if not self.width:
            return 0, 0
        first, last = (max(0, -(-(b - self.begin) // self.width)) for b in (low, high))
        return min(first, self.rows), min(last, self.rows)

    def read(self, source, first: int, last: int, n_columns: int) -> np.ndarray:
        """Rows first .. last - 1 of the first columns, as doubles; lacking columns are nan."""
        size, have = self.dtype.itemsize, min(n_columns, self.columns)
        if self.by_column:
            out = np.full((last - first, n_columns), np.nan)
            for k in range(have):
                source.seek(self.begin + (k * self.rows + first) * size)
                out[:, k] = np.frombuffer(source.read((last - first) * size), self.dtype)
            return out
        source.seek(self.begin + first * self.width)
        block = np.frombuffer(source.read((last - first) * self.width), self.dtype).reshape(-1, self.columns)
        if have == n_columns:
            return block[:, :have].astype(float)
        return np.hstack([block[:, :have].astype(float), np.full((len(block), n_columns - have), np.nan)])


class Ranges(InputPartition):
    """(file, low byte, high byte) of everything a task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


def planned(files: Sequence[tuple[str, int]], task_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Byte ranges by task: at most ``task_bytes`` each, small files together."""
    tasks, own, held = [], [], 0
    for path, length in files:
        low = 0
        while low < length:
            high = min(length, low + task_bytes - held)
            own.append((path, low, high))
            held += high - low
            low = high
            if held >= task_bytes:
                tasks.append(own)
                own, held = [], 0
    return tasks + [own] if own else tasks


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [(p, n) for p, n in json.loads(options["files"])]
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.columns = options["columns"].split(",")
        self.low, self.high, self.wanted = 0, _MOST, None

    def pushFilters(self, filters):
        for one in filters:
            if not self._take(one):
                yield one

    def _take(self, one) -> bool:
        name = one.attribute if hasattr(one, "attribute") else None
        value = getattr(one, "value", None)
        if name == ("file",) and isinstance(one, EqualTo | In):
            files = {value} if isinstance(one, EqualTo) else set(value)
            self.wanted = files if self.wanted is None else self.wanted & files
        elif name == ("row",) and isinstance(one, EqualTo):
            self.low, self.high = max(self.low, value), min(self.high, value + 1)
        elif name == ("row",) and isinstance(one, GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, value + isinstance(one, GreaterThan))
        elif name == ("row",) and isinstance(one, LessThan | LessThanOrEqual):
            self.high = min(self.high, value + isinstance(one, LessThanOrEqual))
        else:
            return False
        return True

    def partitions(self) -> list[Ranges]:
        files = [f for f in self.files if self.wanted is None or f[0] in self.wanted]
        return [Ranges(task) for task in planned(files, self.task_bytes)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, low, high in partition.ranges:
            system, place = opened(path)
            with system.open_input_file(place) as source:
                header = ArrayHeader(source)
                first, last = header.rows_of(low, high)
                first, last = max(first, self.low), min(last, self.high)
                for at in range(first, last, BATCH_ROWS):
                    upto = min(last, at + BATCH_ROWS)
                    block = header.read(source, at, upto, len(self.columns))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(block)), pa.array(np.arange(at, upto)), *[pa.array(c) for c in block.T]],
                        names=["file", "row", *self.columns],
                    )


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"].rstrip("/"), uuid.uuid4().hex

    def _aside(self) -> str:
        return f"{self.path}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _ = opened(self.path)
        attempt, done, name, parts = uuid.uuid4().hex, [], None, []

        def close() -> None:
            whole = np.concatenate(parts)
            aside = f"{self._aside()}/{attempt}/{name}"
            place = opened(aside)[1]
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(place) as sink:
                head = {"descr": np.lib.format.dtype_to_descr(whole.dtype), "fortran_order": False, "shape": whole.shape}
                np.lib.format.write_array_header_1_0(sink, head)
                sink.write(np.ascontiguousarray(whole).tobytes())
            done.append((aside, f"{self.path}/{name}"))

        for batch in iterator:
            files = batch.column(0).dictionary_encode()
            codes = files.indices.to_numpy()
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]], axis=1)
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                own = files.dictionary[int(codes[low])].as_py()
                if name is not None and own != name:
                    close()
                    parts.clear()
                name = own
                parts.append(values[low:high])
        if parts:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        system, _ = opened(self.path)
        for message in messages:
            for aside, final in message.files if message is not None else []:
                place = opened(final)[1]
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                system.move(opened(aside)[1], place)
        self.abort(messages)

    def abort(self, messages) -> None:
        system, place = opened(self._aside())
        if system.get_file_info(place).type == pafs.FileType.Directory:
            system.delete_dir(place)


class ArrayFiles(DataSource):
    """Options: ``files`` (JSON list of path and length), ``columns``, ``taskbytes``; ``path`` for writing."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(["file string", "row long", *(f"{c} double" for c in self.options["columns"].split(","))])

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options)


def read_arrays(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """file, row and the first columns of every array under ``path`` (folders and patterns as Spark knows them).

    Sets ``spark.sql.python.filterPushdown.enabled``, without which Spark refuses a source that takes conditions. The driver
    holds the names and lengths of the files, as Spark does for its own formats.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayFiles)
    found = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "length")
    files = sorted((r["path"], r["length"]) for r in found.collect())
    return (
        spark.read.format(FORMAT)
        .options(files=json.dumps(files), columns=",".join(columns), taskBytes=task_bytes)
        .load()
    )


def write_arrays(df: DataFrame, path: str, file: str, order: str, columns: Sequence[str]) -> None:
    """One array per value of ``file`` (a path below ``path``), rows in the order of ``order``; nulls become nan.

    An array is one task's work to write: give a long recording several files.
    """
    df.sparkSession.dataSource.register(ArrayFiles)
    rows = df.select(F.col(file).cast("string").alias("file"), F.col(order).cast("long").alias("row"), *[F.col(c).cast("double") for c in columns])
    dealt = rows.repartition("file").sortWithinPartitions("file", "row")
    dealt.write.format(FORMAT).options(path=path, columns=",".join(columns)).mode("append").save()
