"""Fixed-width binary files: arrays of doubles or integers by position, mapping records, graph positions."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from genoflux.shipping import ship

from . import store

#: Fields of the records with their places, little-endian, and sizes of the records, with C padding on 64-bit machines.
RECORDS = {
    "double": ([("value", "<f8", 0)], 8),
    "int": ([("value", "<i4", 0)], 4),
    "mapping": ([("read_id", "<i8", 0), ("orientation", "S1", 8), ("ref_name", "S10", 9), ("ref_pos", "<i8", 24), ("normodds", "<f8", 32)], 40),
    "graph": ([("contig", "S32", 0), ("start", "<i8", 32), ("end", "<i8", 40), ("strand", "S1", 48), ("edge_id", "<i8", 56)], 64),
}
#: Records that a decoded row batch stands for.
CHUNK = 8192
#: Bytes of a file that one task reads.
STRETCH = 64 << 20


def layout(kind: str) -> np.dtype:
    fields, size = RECORDS[kind]
    return np.dtype({"names": [f[0] for f in fields], "formats": [f[1] for f in fields], "offsets": [f[2] for f in fields], "itemsize": size})


def schema(kind: str) -> str:
    types = {"f": "double", "i": "long", "S": "string"}
    return "pos long, " + ", ".join(f"`{n}` {types[np.dtype(t).kind]}" for n, t, _ in RECORDS[kind][0])


def _column(a: np.ndarray) -> pa.Array:
    if a.dtype.kind != "S":
        return pa.array(a.astype("f8" if a.dtype.kind == "f" else "i8"))
    names, which = np.unique(a, return_inverse=True)  # names are few, records many
    return pa.array([x.split(b"\0")[0].decode() for x in names.tolist()], pa.string()).take(pa.array(which))


def decode(kind: str, at: int, body: bytes) -> pa.RecordBatch:
    """Records of a stretch of a file whose first has the number `at`, from 0."""
    r = np.frombuffer(body, layout(kind))
    names = [f[0] for f in RECORDS[kind][0]]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(at + 1, at + 1 + len(r))), *(_column(r[n]) for n in names)], ["pos", *names])


def _stretches(records) -> Iterator[tuple[int, bytearray]]:
    """Consecutive records put together, with the number of the first."""
    first, held, n = 0, [], 0
    for k, body in records:
        if held and (n == CHUNK or k != first + n):
            yield first, bytearray(b"".join(held))
            held, n = [], 0
        if not held:
            first = k
        held.append(bytes(body))
        n += 1
    if held:
        yield first, bytearray(b"".join(held))


def _cleaned(d: DataFrame, missing: float | None) -> DataFrame:
    return d if missing is None else d.withColumn("value", F.when(F.col("value") != missing, F.col("value")))


def read_records(spark: SparkSession, path: str, kind: str, missing: float | None = None) -> DataFrame:
    """(pos, ...) of every record of a file; pos counts from 1. A double equal to `missing` becomes null.

    Files are split at whole records, so that one large array is many tasks; records are decoded by the thousand. The parts of a folder are one file.
    """
    ship(spark)
    fs, p = _file(spark, path)
    if "," not in path and not any(c in path for c in "*?[{") and fs.getFileStatus(p).isDirectory():
        return read_range(spark, path, kind, 1, None, missing)
    conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(RECORDS[kind][1])}
    kinds = ("org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable")
    parts = spark.sparkContext.newAPIHadoopFile(path, *kinds, conf=conf).mapPartitions(_stretches)

    def run(batches):
        for b in batches:
            for at, body in zip(b.column(0).to_pylist(), b.column(1)):
                yield decode(kind, at, body.as_buffer())

    return _cleaned(spark.createDataFrame(parts, "at long, body binary").mapInArrow(run, schema(kind)), missing)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def count_records(spark: SparkSession, path: str, kind: str) -> int:
    fs, p = _file(spark, path)
    files = fs.listStatus(p) if fs.getFileStatus(p).isDirectory() else [fs.getFileStatus(p)]
    return sum(f.getLen() // RECORDS[kind][1] for f in files if f.isFile() and f.getPath().getName()[0] not in "._")


@dataclass
class _Piece(InputPartition):
    path: str
    offset: int  # of the first record, in the file
    n: int
    at: int  # number of that record, from 0


class _RecordReader(DataSourceReader):
    def __init__(self, path: str, kind: str, start: int, end: int | None):
        self.path, self.kind, self.start, self.end = path, kind, start, end

    def pushFilters(self, filters):
        """Bounds of pos decide what is read; Spark looks at each row again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("pos",) and isinstance(getattr(f, "value", None), int):
                low = {EqualTo: f.value, GreaterThan: f.value + 1, GreaterThanOrEqual: f.value}.get(type(f))
                high = {EqualTo: f.value, LessThan: f.value - 1, LessThanOrEqual: f.value}.get(type(f))
                self.start = self.start if low is None else max(self.start, low)
                self.end = self.end if high is None else min(high, self.end if self.end is not None else high)
            yield f

    def partitions(self) -> list[_Piece]:
        size, at, out = RECORDS[self.kind][1], 0, []
        for path, length in store.listed(self.path):
            n = length // size
            first, last = max(self.start - 1, at), min(at + n, at + n if self.end is None else self.end)
            step = max(1, STRETCH // size)
            out += [_Piece(path, (k - at) * size, min(step, last - k), k) for k in range(first, last, step)]
            at += n
        return out or [_Piece("", 0, 0, 0)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        size = RECORDS[self.kind][1]
        if not partition.n:
            return
        with store.opened(partition.path) as f:
            f.seek(partition.offset)
            for k in range(0, partition.n, CHUNK):
                body = f.read(min(CHUNK, partition.n - k) * size)
                yield decode(self.kind, partition.at + k, body)


class RecordSource(DataSource):
    """Records of a file, or of a folder of its parts in order of their names; pos goes on from part to part."""

    @classmethod
    def name(cls) -> str:
        return "genoflux_records"

    def schema(self) -> str:
        return schema(self.options["kind"])

    def reader(self, schema) -> _RecordReader:
        end = self.options.get("end")
        return _RecordReader(self.options["path"], self.options["kind"], int(self.options.get("start", "1")), None if end is None else int(end))


def read_range(spark: SparkSession, path: str, kind: str, start: int, end: int | None, missing: float | None = None) -> DataFrame:
    """(pos, ...) of the records start..end (from 1, closed; no end: all) of a file or folder of parts. Tasks get stretches of some
    STRETCH bytes and seek them; nothing else is read. Filters on pos narrow the range before tasks are made."""
    d = spark.read.format(store.registered(spark, RecordSource)).option("path", path).option("kind", kind).option("start", str(max(1, start)))
    return _cleaned((d if end is None else d.option("end", str(end))).load(), missing)


def records_from(spark: SparkSession, path: str, kind: str, offset: int, missing: float | None = None) -> DataFrame:
    """Records of a file or folder of parts after the first `offset`; of a negative one, the last so many."""
    n = count_records(spark, path, kind)
    return read_range(spark, path, kind, offset + 1 if offset >= 0 else n + offset + 1, n, missing)


def pack_array(values: list[float | None], missing: float = -1.0) -> bytes:
    """A block of doubles as the files hold them, nulls as `missing`."""
    return struct.pack(f"<{len(values)}d", *(missing if v is None else v for v in values))


def _sparse(cov: DataFrame, value: str, block: int) -> DataFrame:
    """(chr, block, m): places in the block, from 0, and values of the rows of each block that has some."""
    at = ((F.col("pos") - 1) % block).cast("int")
    return cov.groupBy("chr", F.floor((F.col("pos") - 1) / block).alias("block")).agg(F.collect_list(F.struct(at.alias("at"), F.col(value).cast("double").alias("v"))).alias("m"))


def _dense(m: pa.ListArray, block: int, empty: float) -> np.ndarray:
    """A row of `block` doubles for each list of (place, value); null lists and values are empty."""
    n = m.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = m.flatten()
    place = np.repeat(np.arange(len(m)) * block, n) + flat.field("at").to_numpy(zero_copy_only=False)
    if len(np.unique(place)) != len(place):
        raise ValueError("a position has two values")
    out = np.full(len(m) * block, empty, "<f8")
    out[place] = flat.field("v").fill_null(empty).to_numpy(zero_copy_only=False)
    return out.reshape(len(m), block)


#: Blocks that are made at once.
AT_ONCE = 256


def _each_dense(batches, block: int, empty: float):
    for b in batches:
        for i in range(0, b.num_rows, AT_ONCE):
            part = b.slice(i, AT_ONCE)
            yield part, _dense(part.column(2), block, empty)


def dense_blocks(cov: DataFrame, value: str, block: int = 4096, empty: float = 0.0) -> DataFrame:
    """(chr, block, body): values by position (from 1) in blocks of doubles, positions without a row as `empty`."""
    d = _sparse(cov, value, block)

    def run(batches):
        for b, rows in _each_dense(batches, block, empty):
            body = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, block, dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), body], ["chr", "block", "body"])

    ship(cov.sparkSession)
    return d.mapInArrow(run, f"chr {d.schema['chr'].dataType.simpleString()}, block long, body array<double>")


def array_blocks(cov: DataFrame, value: str, block: int = 4096, empty: float = 0.0) -> DataFrame:
    """(name, part, body binary): the whole array of each chr in order, blocks without a row included, for save_files."""
    d = _sparse(cov, value, block)
    every = d.groupBy("chr").agg(F.max("block").alias("last")).select("chr", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("block"))
    d = every.join(d, ["chr", "block"], "left").select("chr", "block", "m")

    def run(batches):
        for b, rows in _each_dense(batches, block, empty):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["name", "part", "body"])

    ship(cov.sparkSession)
    return d.mapInArrow(run, "name string, part long, body binary")


def save_files(bodies: DataFrame, folder: str) -> None:
    """One file for each name of bodies (name, part, body), its parts in order, written by the task that gets the name; files go side by side."""
    store.write_bodies(bodies.repartition("name").sortWithinPartitions("name", "part"), folder)


def save_parts(bodies: DataFrame, folder: str) -> None:
    """Each name of bodies (name, part, body) as a folder of parts that make up the file in order of their names: a file of any length is written by many tasks."""
    d = bodies.repartitionByRange("name", "part").sortWithinPartitions("name", "part")
    store.write_bodies(d, folder, True)


def record_bodies(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """(name, part, body): rows as records of a kind, in the order of their tasks, for save_parts."""
    fields = RECORDS[kind][0]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            r = np.zeros(b.num_rows, layout(kind))
            for n, t, _ in fields:
                r[n] = np.array([x.encode() for x in b.column(n).to_pylist()], t) if t[0] == "S" else b.column(n).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part]), pa.array([r.tobytes()], pa.binary())], ["name", "part", "body"])
            part += 1

    ship(rows.sparkSession)
    return rows.select(*(f[0] for f in fields)).mapInArrow(run, "name string, part long, body binary")
