"""Parquet packages that carry their descriptor in every file footer.

Spark's Parquet writer has no option for footer keys, so packages are written by
a Python data source: every task turns the Arrow batches it is given into files
with the key set, in a staging folder, and the commit moves the finished files
into place. A task that is run again writes files of its own, and only the files
of the attempt that was committed are kept.
"""

from __future__ import annotations

import json
import posixpath
import re
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from packwright import standard as S

DESCRIPTOR_KEY = "datapackage.json"
# A leading underscore keeps readers of the folder from taking it for data.
SIDECAR = "_datapackage.json"
# Files are closed at a tenth of the largest size the standard allows.
TARGET_FILE_BYTES = S.MAX_FILE_MB * 1024 * 1024 // 10
# A row group is written when it holds so many bytes of Arrow data or so many rows.
ROW_GROUP_BYTES = 128 << 20
ROW_GROUP_ROWS = 1 << 20
# Files that a commit moves at a time.
MOVES = 32

# Tasks get this module by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
        return pafs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))
    return pafs.LocalFileSystem(), path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system; one without a scheme is on the cluster's default file system, as for Spark's own readers and writers."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString()


def _on_cluster(path: str) -> str:
    """The same for the active session; tasks and programs without one are given whole paths."""
    spark = SparkSession.getActiveSession()
    return path if spark is None else qualified(spark, path)


def make_dir(path: str) -> None:
    """Create a folder, with those above it."""
    fs, target = _filesystem(_on_cluster(path))
    fs.create_dir(target, recursive=True)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _PackageWriter(DataSourceArrowWriter):
    def __init__(self, path: str, descriptor: str, schema: StructType, overwrite: bool,
                 target_bytes: int):
        self.path = path
        self.descriptor = descriptor
        self.schema = schema
        self.overwrite = overwrite
        self.target_bytes = target_bytes
        self.staging = posixpath.join(path, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, staging = _filesystem(self.staging)
        fs.create_dir(staging, recursive=True)
        schema = to_arrow_schema(self.schema).with_metadata(
            {DESCRIPTOR_KEY: self.descriptor.encode("utf-8")})
        files: list[str] = []
        writer = sink = None
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            """Write what is held as one row group."""
            nonlocal writer, sink
            if not held:
                return
            if writer is None:
                name = f"part-{uuid.uuid4().hex}.parquet"
                sink = fs.open_output_stream(posixpath.join(staging, name))
                writer = pq.ParquetWriter(sink, schema)
                files.append(name)
            table = pa.Table.from_batches(held).rename_columns(schema.names).cast(schema)
            writer.write_table(table, row_group_size=table.num_rows)
            held.clear()
            if sink.tell() >= self.target_bytes:
                writer.close()
                sink.close()
                writer = None

        try:
            limit = min(ROW_GROUP_BYTES, self.target_bytes)
            size = rows = 0
            for batch in iterator:
                held.append(batch)
                size, rows = size + batch.nbytes, rows + batch.num_rows
                if size >= limit or rows >= ROW_GROUP_ROWS:
                    flush()
                    size = rows = 0
            flush()
        finally:
            if writer is not None:
                writer.close()
                sink.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, target = _filesystem(self.path)
        _, staging = _filesystem(self.staging)
        names = [name for m in messages if m is not None for name in m.files]
        fs.create_dir(staging, recursive=True)
        if not names:
            # An empty table is still a package: one file with the schema.
            schema = to_arrow_schema(self.schema).with_metadata(
                {DESCRIPTOR_KEY: self.descriptor.encode("utf-8")})
            names = [f"part-{uuid.uuid4().hex}.parquet"]
            with fs.open_output_stream(posixpath.join(staging, names[0])) as sink:
                pq.write_table(schema.empty_table(), sink)
        old = []
        if self.overwrite:
            listing = fs.get_file_info(pafs.FileSelector(target, recursive=False))
            old = [f.path for f in listing if f.is_file and f.base_name.endswith(".parquet")]
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda name: fs.move(posixpath.join(staging, name), posixpath.join(target, name)), names))
        for path in old:
            fs.delete_file(path)
        with fs.open_output_stream(posixpath.join(target, SIDECAR)) as out:
            out.write(self.descriptor.encode("utf-8"))
        fs.delete_dir(staging)

    def abort(self, messages: list[_Written | None]) -> None:
        fs, staging = _filesystem(self.staging)
        if fs.get_file_info(staging).type == pafs.FileType.Directory:
            fs.delete_dir(staging)


class PackageSource(DataSource):
    """Write-only source ``packwright-package``: options ``path``, ``descriptor``, ``target_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "packwright-package"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _PackageWriter(self.options["path"], self.options["descriptor"], schema, overwrite,
                              int(self.options.get("target_bytes", TARGET_FILE_BYTES)))


def pack_write(df: DataFrame, descriptor: dict, path: str, mode: str = "overwrite",
               target_bytes: int = TARGET_FILE_BYTES) -> None:
    """Write a table as a package. The folder above ``path`` must exist."""
    if not isinstance(descriptor, dict):
        raise TypeError("descriptor must be a dictionary")
    path = qualified(df.sparkSession, path)
    fs, target = _filesystem(path)
    parent = posixpath.dirname(target.rstrip("/"))
    if fs.get_file_info(parent).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"The directory {parent} does not exist.")
    df.sparkSession.dataSource.register(PackageSource)
    (df.write.format("packwright-package").option("path", path)
     .option("descriptor", json.dumps(descriptor)).option("target_bytes", target_bytes)
     .mode(mode).save())


def annotate(df: DataFrame, fields: list[dict]) -> DataFrame:
    """Put the field definitions into the metadata of the columns.

    Spark's own Parquet writer keeps them, so a table written without the
    package source still carries units and concepts per column.
    """
    known = {f["name"]: f for f in fields}
    return df.select(*[
        df[f"`{c}`"].alias(c, metadata={k: v for k, v in known[c].items() if k != "name"})
        if c in known else df[f"`{c}`"]
        for c in df.columns
    ])


def _descriptor_text(metadata: dict | None) -> str | None:
    value = (metadata or {}).get(DESCRIPTOR_KEY.encode())
    return None if value is None else value.decode("utf-8")


def read_descriptor(path: str) -> dict:
    """Descriptor of a package from one footer; ``{}`` where it has none."""
    fs, target = _filesystem(_on_cluster(path))
    info = fs.get_file_info(target)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"The file {path} does not exist.")
    if info.type == pafs.FileType.Directory:
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(target, recursive=False))
                 if f.is_file and f.base_name.endswith(".parquet")]
        if not files:
            raise FileNotFoundError(f"No Parquet file in {path}.")
        target = min(files)
    with fs.open_input_file(target) as source:
        text = _descriptor_text(pq.read_schema(source).metadata)
    return {} if text is None else json.loads(text)


def pack_read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A package as ``(table, descriptor)``."""
    descriptor = read_descriptor(path)
    return spark.read.parquet(path), descriptor


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            fs, target = _filesystem(path)
            with fs.open_input_file(target) as source:
                footer = pq.ParquetFile(source)
                text = _descriptor_text(footer.schema_arrow.metadata)
                rows.append({
                    "path": path, "num_rows": footer.metadata.num_rows,
                    "num_columns": len(footer.schema_arrow.names),
                    "has_descriptor": text is not None, "descriptor_json": text,
                })
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("path", pa.string()), ("num_rows", pa.int64()), ("num_columns", pa.int32()),
            ("has_descriptor", pa.bool_()), ("descriptor_json", pa.string()),
        ]))


def pack_catalog(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """Descriptor of every Parquet file below a folder; only footers are read, by many tasks.

    Result: ``path, num_rows, num_columns, has_descriptor, descriptor_json``.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True).load(path).select("path")
    )
    files = files.repartition(tasks or spark.sparkContext.defaultParallelism * 4, "path")
    return files.mapInArrow(
        _footers, "path string, num_rows long, num_columns int, has_descriptor boolean, "
                  "descriptor_json string")
