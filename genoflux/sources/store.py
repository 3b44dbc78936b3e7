"""Files that tasks write and read themselves: whole files or parts of them with commit and abort, and reading by seeks.

Tasks reach files through Arrow's file systems, whose URIs are those of local and shared folders (file:), S3, GCS and HDFS.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from genoflux.shipping import ship


def resolved(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def opened(path: str) -> pa.NativeFile:
    """A file to be read by seeks."""
    fs, p = resolved(path)
    return fs.open_input_file(p)


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder in order of their names, but for those that begin with _ or a dot."""
    fs, p = resolved(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = sorted((x for x in fs.get_file_info(pafs.FileSelector(p)) if x.type == pafs.FileType.File), key=lambda x: x.base_name)
    return [(f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found if x.base_name[0] not in "._" and x.base_name.endswith(suffix)]


_registered: set[tuple[str, type]] = set()


def registered(spark: SparkSession, source: type[DataSource]) -> str:
    """The name under which a session knows a data source, whose filters it may be given."""
    ship(spark)
    key = (spark.sparkContext.applicationId + str(id(spark._jsparkSession)), source)
    if key not in _registered:
        spark.dataSource.register(source)
        _registered.add(key)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return source.name()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a task has put a file, and its name


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, parts: bool):
        self.folder, self.parts = folder.rstrip("/"), parts
        self.aside = f"{self.folder}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        own, files, out, now = f"{self.aside}/{uuid.uuid4().hex}", [], None, None
        fs, base = resolved(own)
        for b in iterator:
            for name, part, body in zip(*(b.column(c) for c in ("name", "part", "body"))):
                name = name.as_py()
                if name != now:
                    if out is not None:
                        out.close()
                    now, final = name, f"{name}/part-{part.as_py():015d}" if self.parts else name
                    at = f"{base}/{len(files)}"
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(at, buffer_size=1 << 20)
                    files.append((f"{own}/{len(files)}", final))
                out.write(body.as_buffer())
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        fs, base = resolved(self.folder)
        for m in messages:
            for at, name in m.files if m else ():
                to = f"{base}/{name}"
                fs.create_dir(to.rpartition("/")[0], recursive=True)
                fs.move(resolved(at)[1], to)
        self._sweep()

    def abort(self, messages) -> None:
        self._sweep()

    def _sweep(self) -> None:
        fs, p = resolved(self.aside)
        if fs.get_file_info(p).type == pafs.FileType.Directory:
            fs.delete_dir(p)


class FileSink(DataSource):
    """Bytes (name, part, body) as files of a folder. Each task puts its files aside; they get their names when all tasks have ended."""

    @classmethod
    def name(cls) -> str:
        return "genoflux_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("parts") == "true")


def write_bodies(bodies: DataFrame, folder: str, parts: bool = False) -> None:
    """Files of bodies (name, part, body) as they lie in their tasks: a change of name begins a file, or with `parts` a part of it, `name/part-<number>`."""
    spark = bodies.sparkSession
    d = bodies.selectExpr("cast(name as string) as name", "cast(part as bigint) as part", "cast(body as binary) as body")
    d.write.format(registered(spark, FileSink)).mode("append").option("path", folder).option("parts", str(parts).lower()).save()
