"""Files of vectors: ``spark.read.format("vectors")`` and ``df.write.format("vectors")`` on folders of NumPy's ``.npy`` files, a matrix of 32-bit floats each.

Reading: ``path`` is a file or a folder. A file is split into ranges of ``rows`` rows, each a task that seeks to its bytes and reads no others. The row number is the offset: a file's rows follow those of the
files before it, so no sort is needed, and vectors pair with other rows by position.

Writing: the rows of a DataFrame with (row, embedding), of which every task must hold a range in order (``in_ranges`` sees to that). A task writes files of at most ``rows`` rows under new names; the
commit, on the driver, puts the list of the files in order of their first row in ``_files.json``, which readers go by. Files of a failed task or job are in no list. Only that list, a line a file, is held by the driver.

Files are opened through pyarrow's file systems, so an address may name any that pyarrow knows. An empty folder has no rows; a folder without a list is read in order of names.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROWS = 16_384
LIST = "_files.json"
_SCHEMA = pa.schema([("row", pa.int64()), ("embedding", pa.list_(pa.float32()))])


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _shape(store: fs.FileSystem, file: str) -> tuple[int, int, int]:
    """(rows, dimensions, where the numbers begin) of a file, from its header alone."""
    with store.open_input_file(file) as f:
        head = io.BytesIO(f.read(10))
        version = np.lib.format.read_magic(head)
        size = struct.unpack("<H", head.read(2))[0] if version == (1, 0) else None
        if size is None:
            raise ValueError(f"{file} is not of version 1.0")
        whole = io.BytesIO(f.read(size))
    text = io.BytesIO(struct.pack("<H", size) + whole.getvalue())
    shape, by_columns, kind = np.lib.format.read_array_header_1_0(text)
    if len(shape) != 2 or by_columns or kind != np.dtype("<f4"):
        raise ValueError(f"{file} is no matrix of 32-bit floats by rows")
    return shape[0], shape[1], 10 + size


@dataclass
class Range(InputPartition):
    file: str
    begin: int  # byte
    rows: int
    dimensions: int
    first: int  # row number


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "row bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))

    def files(self) -> list[str]:
        store, path = _opened(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return [path]
        if store.get_file_info(f"{path}/{LIST}").type == fs.FileType.File:
            with store.open_input_file(f"{path}/{LIST}") as f:
                return [f"{path}/{name}" for name in json.loads(f.read())]
        return sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.path.endswith(".npy"))

    def partitions(self) -> list[Range]:
        store, out, first = _opened(self.path)[0], [], 0
        for file in self.files():
            n, d, begin = _shape(store, file)
            out += [Range(file, begin + 4 * d * at, min(self.rows, n - at), d, first + at) for at in range(0, n, self.rows)]
            first += n
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        with _opened(self.path)[0].open_input_file(partition.file) as f:
            flat = np.frombuffer(f.read_at(4 * partition.rows * partition.dimensions, partition.begin), "<f4")
        places = np.arange(0, len(flat) + 1, partition.dimensions, dtype=np.int32)
        numbers = np.arange(partition.first, partition.first + partition.rows)
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.ListArray.from_arrays(pa.array(places), pa.array(flat))], schema=_SCHEMA)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]  # first row, name


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.rows, self.overwrite = options["path"], int(options.get("rows", ROWS)), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, path = _opened(self.path)
        store.create_dir(path)
        files, held, n = [], [], 0

        def flush() -> None:
            table = pa.Table.from_batches(held)
            matrix = np.asarray(table["embedding"].combine_chunks().flatten(), "<f4").reshape(table.num_rows, -1)
            name, body = f"part-{uuid.uuid4().hex}.npy", io.BytesIO()
            np.lib.format.write_array(body, np.ascontiguousarray(matrix), version=(1, 0))
            with store.open_output_stream(f"{path}/{name}") as f:
                f.write(body.getvalue())
            files.append((table["row"][0].as_py(), name))

        for batch in batches:
            for at in range(0, batch.num_rows, self.rows):
                part = batch.slice(at, self.rows)
                if n and n + part.num_rows > self.rows:
                    flush()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _opened(self.path)
        store.create_dir(path)
        before = [] if self.overwrite else [f.rsplit("/", 1)[-1] for f in _Reader({"path": self.path}).files()]
        names = before + [name for _, name in sorted(f for m in messages if m for f in m.files)]
        with store.open_output_stream(f"{path}/{LIST}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = _opened(self.path)
        for _, name in (f for m in messages if m for f in m.files):
            store.delete_file(f"{path}/{name}")


def in_ranges(vectors: DataFrame, order: str, embedding: str = "embedding") -> DataFrame:
    """``vectors`` as (row, embedding) in ranges of the column ``order``, sorted inside each: what the writer takes. Nothing is sorted as a whole."""
    rows = vectors.filter(F.col(embedding).isNotNull()).select(F.col(order).cast("long").alias("row"), F.col(embedding).cast("array<float>").alias("embedding"))
    return rows.repartitionByRange("row").sortWithinPartitions("row")
