"""Tables that are whole or not there, in canonical order.

``committed`` is a data source for writing. Each task writes one Parquet part of a new version and reports it with its rows and digest; when
all tasks have reported, the driver replaces the table's record of parts in one rename. What readers see is the record: parts of tasks that
were lost, repeated or never reported are no part of the table, and a run that fails leaves the version before it as it was.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "committed"
RECORD = "_parts.json"


class NotCommitted(ValueError):
    pass


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Hashed:
    """A sink that counts and hashes what goes through it, so that a part is written and read once."""

    closed = False

    def __init__(self, to: pa.NativeFile) -> None:
        self.to, self.digest, self.size = to, hashlib.sha256(), 0

    def write(self, data) -> int:
        self.digest.update(data)
        self.size += len(data)
        self.to.write(data)
        return len(data)

    def flush(self) -> None:
        self.to.flush()

    def tell(self) -> int:
        return self.size

    def close(self) -> None:
        self.to.close()


@dataclass
class Part(WriterCommitMessage):
    place: int
    file: str
    rows: int
    bytes: int
    sha256: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, compression: str, overwrite: bool) -> None:
        self.path, self.compression, self.overwrite, self.version = path.rstrip("/"), compression, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = _store(self.path)
        place, writer, rows = TaskContext.get().partitionId(), None, 0
        file = f"{self.version}/part-{place:05d}-{uuid.uuid4().hex}.parquet"
        for batch in iterator:
            if writer is None:
                store.create_dir(f"{root}/{self.version}", recursive=True)
                sink = _Hashed(store.open_output_stream(f"{root}/{file}"))
                writer = pq.ParquetWriter(pa.PythonFile(sink, "w"), batch.schema, compression=self.compression)
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer is None:
            return Part(place, "", 0, 0, "")  # no rows, no part
        writer.close()
        sink.close()
        return Part(place, file, rows, sink.size, sink.digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        before = [] if self.overwrite else _record(self.path, [])
        parts = before + [vars(p) for p in sorted((m for m in messages if m and m.file), key=lambda p: p.place)]
        temporary = f"{root}/{RECORD}-{self.version}"
        with store.open_output_stream(temporary) as out:
            out.write(json.dumps({"version": self.version, "parts": parts}).encode())
        store.move(temporary, f"{root}/{RECORD}")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.version}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.version}")


class Committed(DataSource):
    """Options: path, compression (zstd). Append keeps the parts that are there, overwrite replaces them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("compression", "zstd"), overwrite)


def _record(path: str, otherwise: list | None = None) -> list[dict]:
    store, root = _store(path.rstrip("/"))
    if store.get_file_info(f"{root}/{RECORD}").type != fs.FileType.File:
        if otherwise is None:
            raise NotCommitted(f"{path}: no version was ever committed")
        return otherwise
    with store.open_input_stream(f"{root}/{RECORD}") as f:
        return json.loads(f.read())["parts"]


def vacuum(path: str) -> int:
    """Deletes versions of which the record names no part, and says how many there were: what tasks that went on after their run had failed
    have left, and what was replaced. For times when nothing writes or reads an older version."""
    store, root = _store(path.rstrip("/"))
    named = {p["file"].split("/", 1)[0] for p in _record(path)}
    folders = [f for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.Directory and f.base_name not in named]
    for f in folders:
        store.delete_dir(f.path)
    return len(folders)


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in the order of the keys, through all partitions: ranges of keys, sorted each."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write(df: DataFrame, path: str, *keys: str, mode: str = "overwrite", compression: str = "zstd") -> None:
    """Writes a version of the table, in the order of ``keys`` where there are any."""
    df.sparkSession.dataSource.register(Committed)
    (in_order(df, *keys) if keys else df).write.format(FORMAT).mode(mode).option("compression", compression).save(path)


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of the version that is committed; other columns of its parts are not read."""
    parts = _record(path)
    rows = spark.read.schema(schema)
    return rows.parquet(*[f"{path.rstrip('/')}/{p['file']}" for p in parts]) if parts else spark.createDataFrame([], schema)


def with_positions(spark: SparkSession, path: str, schema: StructType | str, name: str = "position") -> DataFrame:
    """The rows with their place in the table, from 1: parts in order, rows as they lie in them. Nothing is shuffled."""
    starts, total = [], 0
    for p in _record(path):
        starts.append((p["file"].rsplit("/", 1)[1], total))
        total += p["rows"]
    known = spark.createDataFrame(starts, "_part string, _start long")  # a row a part
    rows = read(spark, path, schema)
    if not starts:
        return rows.withColumn(name, F.lit(None).cast("long"))
    placed = rows.select("*", F.col("_metadata.file_name").alias("_part"), F.col("_metadata.row_index").alias("_row")).join(F.broadcast(known), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_row") + 1).drop("_part", "_start", "_row")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(file, issue) of committed parts that are missing or no longer have their digest; each is read in pieces, by a task of its own."""
    schema, folder = "file string, bytes long, sha256 string", path.rstrip("/")
    known = spark.createDataFrame([(p["file"], p["bytes"], p["sha256"]) for p in _record(path)], schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            out = []
            for file, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if store.get_file_info(f"{root}/{file}").type != fs.FileType.File:
                    out.append((file, "missing"))
                    continue
                own = hashlib.sha256()
                with store.open_input_stream(f"{root}/{file}") as f:
                    while piece := f.read(1 << 20):
                        own.update(piece)
                if own.hexdigest() != digest:
                    out.append((file, "changed"))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["file", "issue"])

    return known.repartition(max(1, known.count()), "file").mapInArrow(each, "file string, issue string")


def out_of_order(rows: DataFrame, position: str, *keys: str, block: int = 1 << 20) -> DataFrame:
    """Rows whose keys are smaller than those of the row before them, by blocks of positions, which also see the last row of the block before."""
    key, place = F.struct(*keys), F.floor((F.col(position) - 1) / block)
    last = F.explode(F.when(F.col(position) % block == 0, F.array(place, place + 1)).otherwise(F.array(place))).alias("_block")
    order = Window.partitionBy("_block").orderBy(position)
    both = rows.select("*", last).withColumn("_before", F.lag(key).over(order))
    return both.where((F.col("_before") > key) & (place == F.col("_block"))).drop("_block", "_before")
