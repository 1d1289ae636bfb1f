"""Reading and writing record files: the ``marc`` data source, and the scans that split files."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import codecs
from quire.schema import RECORD
from quire.sources import iso2709 as I

EXTENSIONS = {"mrc": "marc", "marc": "marc"}
#: Records in an Arrow batch of the sequential reader.
BATCH = 500


def format_of(path: str) -> str | None:
    """marc for .mrc and .marc, else None."""
    return EXTENSIONS.get(path.rpartition(".")[2].lower() if "." in path else "")


def _files(path: str) -> list[str]:
    at = unquote(urlparse(path).path) if path.startswith("file:") else path
    if os.path.isdir(at):
        return sorted(os.path.join(at, f) for f in os.listdir(at) if not f.startswith(("_", ".")))
    return [at]


@dataclass
class _File(InputPartition):
    path: str
    number: int


class MarcReader(DataSourceReader):
    """One task for each file, which frames records by the lengths in their leaders, as only a sequential reader can.

    Options: kind, mode (FAILFAST or PERMISSIVE), validation (structural or strict_marc), max_errors (0: any number).
    """

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(x for path in self.options["path"].split(",") for x in _files(path))]

    def read(self, partition: _File):
        kind, mode, validation = self.options.get("kind", "bib"), self.options.get("mode", "FAILFAST"), self.options.get("validation", "structural")
        most, seen, rows, last = int(self.options.get("max_errors", 10_000)), 0, [], False
        target = to_arrow_schema(self.schema)
        frames = I.by_length(open(partition.path, "rb"))
        index = 0
        while not last:
            index += 1
            try:
                offset, raw = next(frames)
                got = I.salvage(raw, kind, mode, validation, index, offset)
            except StopIteration:
                break
            except I.MarcError as error:
                if mode.upper() == "FAILFAST":
                    raise
                offset, got, last = error.info.get("byte_offset"), {"leader": None, "control": [], "fields": [], "errors": [error.info]}, True
            seen += len(got["errors"])
            if most and seen > most:
                fatal = I.MarcError("E099", "more errors than allowed", record_index=index)
                if mode.upper() == "FAILFAST":
                    raise fatal
                got["errors"], last = [*got["errors"], fatal.info], True
            rows.append({"rec_id": (partition.number << 33) + index - 1, "kind": kind, "source": partition.path, "rec_index": index, "byte_offset": offset, **got})
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_pylist(rows, target)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, target)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    records: int


class MarcWriter(DataSourceArrowWriter):
    """Writes the ``raw`` column; each task has a file of its own, and only committed files get their final name."""

    def __init__(self, path: str, overwrite: bool):
        self.path = unquote(urlparse(path).path) if path.startswith("file:") else path
        if os.path.isdir(self.path) and os.listdir(self.path):
            if not overwrite:
                raise FileExistsError(self.path)
            for f in _files(self.path):
                os.remove(f)
        os.makedirs(self.path, exist_ok=True)

    def write(self, batches):
        name, n = os.path.join(self.path, f"_part-{uuid.uuid4().hex}.mrc"), 0
        with open(name, "wb") as sink:
            for batch in batches:
                for raw in batch.column(batch.schema.get_field_index("raw")).to_pylist():
                    sink.write(raw)
                    n += 1
        return _Written(name, n)

    def commit(self, messages):
        for i, m in enumerate(x for x in messages if x is not None):
            if m.records:
                os.rename(m.path, os.path.join(self.path, f"part-{i:05d}.mrc"))
            else:
                os.remove(m.path)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class MarcSource(DataSource):
    """``spark.read.format("marc")``: record files in a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "marc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema):
        return MarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return MarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MarcSource)


def scan_frames(spark: SparkSession, *paths: str, positions: bool = False) -> DataFrame:
    """Records as bytes, framed by their terminators: files split across tasks.  Positions cost a window for each file."""
    rows = I.frames(spark.read.option("lineSep", "\x1d").text(list(paths)))
    rows = rows.where(F.octet_length("raw") > 1)
    return I.positioned(rows) if positions else rows


def read(spark: SparkSession, *paths: str, kind: str = "bib", mode: str = "PERMISSIVE", validation: str = "structural", framing: str = "terminator", max_errors: int = 10_000, format: str | None = None, positions: bool = False) -> DataFrame:
    """Record files as records.  ``terminator`` framing splits files; ``length`` framing reads each file in one task."""
    if any((format or format_of(p) or ("marc" if "." not in os.path.basename(p) else None)) != "marc" for p in paths):
        raise ValueError(f"unknown format: {paths}")
    if framing == "length":
        register(spark)
        return spark.read.format("marc").options(kind=kind, mode=mode, validation=validation, max_errors=max_errors).load(",".join(paths))
    rows = I.parse(scan_frames(spark, *paths, positions=positions), kind, mode, validation)
    return I.capped(rows, max_errors) if positions else rows


def write(records: DataFrame, path: str, kind: str = "bib", mode: str = "overwrite") -> None:
    """Records as ISO 2709 files, encoded on the JVM; one that does not fit fails the job."""
    register(records.sparkSession)
    I.encoded(records, kind).select("raw").write.format("marc").mode(mode).save(path)


def map_records(function: Callable, spark: SparkSession, *paths: str) -> None:
    """Calls function(row) on the executors for every record of the files."""
    read(spark, *paths).foreach(function)


def convert(records: DataFrame, to: str) -> DataFrame:
    """(rec_id, text) in one of the text formats."""
    make = {"csv": codecs.to_csv, "json": codecs.to_json, "marcjson": codecs.to_marcjson, "dict": codecs.to_dict_json, "marcxml": codecs.to_marcxml, "dc": codecs.to_dublin_core_xml, "mods": codecs.to_mods}[to]
    return records.select("rec_id", make().alias("text"))
