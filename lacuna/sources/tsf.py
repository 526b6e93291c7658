"""Time-series files of the .tsf text format.

A header of ``@attribute name type`` and other ``@`` lines, then ``@data``, then
one series a line: attributes and, last, comma-separated values, all divided by
colons; ``?`` is missing.  ``read_tsf`` parses in Spark expressions over text lines;
``spark.read.format("tsf")``, after ``register``, reads byte ranges of files in tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import LacunaError

_TYPES = {"numeric": "double", "string": "string", "date": "timestamp_ntz"}


def header(lines: list[str]) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """Attributes (name, type) and the other settings."""
    attributes, settings, data = [], {}, False
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if not line.startswith("@"):
            break
        parts = line[1:].split()
        if parts[0] == "data":
            data = True
            break
        if parts[0] == "attribute":
            if len(parts) != 3 or parts[2] not in _TYPES:
                raise LacunaError(f"bad attribute line: {line}")
            attributes.append((parts[1], parts[2]))
        elif len(parts) != 2:
            raise LacunaError(f"bad header line: {line}")
        else:
            settings[parts[0]] = parts[1]
    if not data:
        raise LacunaError("no @data section")
    if not attributes:
        raise LacunaError("no attribute")
    return attributes, settings


def read_tsf(spark: SparkSession, path: str, value_column: str = "series_value", encoding: str = "iso-8859-1") -> DataFrame:
    """One row a series: its attributes and its values as an array of doubles with NULL for ``?``."""
    text = spark.read.option("encoding", encoding).option("header", False).option("quote", "").option("sep", "\x01").csv(path).select(F.col("_c0").alias("value"))
    # Only the header has lines that begin with @; the rest stays distributed.
    attributes, _ = header([r[0] for r in text.where(F.col("value").rlike(r"^\s*@")).collect()])
    parts = F.split("value", ":", len(attributes) + 1)
    cols = []
    for i, (name, kind) in enumerate(attributes):
        raw = F.element_at(parts, i + 1)
        cols.append((F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH-mm-ss")).cast("timestamp_ntz") if kind == "date" else raw.cast(_TYPES[kind])).alias(name))
    values = F.transform(F.split(F.element_at(parts, len(attributes) + 1), ","), lambda v: F.when(F.trim(v) != "?", F.trim(v).cast("double")))
    rows = text.where(~F.col("value").rlike(r"^\s*[@#]") & F.col("value").contains(":"))
    return rows.select(*cols, values.alias(value_column))


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


class TsfReader(DataSourceReader):
    """Reads the series that begin in a range of bytes, in batches of whole lines."""

    def __init__(self, schema: StructType, path: str, split_bytes: int, encoding: str, batch: int = 500):
        self.schema, self.path, self.split, self.encoding, self.batch = schema, path, split_bytes, encoding, batch

    def partitions(self) -> list[Range]:
        store, files = _files(self.path)
        out = []
        for f in files:
            begin = _head(store, f.path, self.encoding)[1]
            # Paths stay as the user wrote them, so that a task finds the same store.
            out += [Range(f"{self.path}\0{f.path}", a, min(a + self.split, f.size)) for a in range(begin, f.size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        root, path = partition.path.split("\0")
        store, _ = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        kinds = [_KINDS[t] for _, t in _head(store, path, self.encoding)[0]]
        names, rows = self.schema.names, []
        with io.BufferedReader(store.open_input_file(path), 1 << 16) as file:
            file.seek(partition.start - 1)
            # The line that runs over the start belongs to the range before.
            at = partition.start - 1 + len(file.readline())
            while at < partition.end:
                line = file.readline()
                if not line:
                    break
                at += len(line)
                text = line.decode(self.encoding).strip()
                if text and not text.startswith("#"):
                    rows.append(_series(text, kinds))
                if len(rows) == self.batch:
                    yield self._made(rows, names)
                    rows = []
        if rows:
            yield self._made(rows, names)

    def _made(self, rows: list[list], names: list[str]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), to_arrow_schema(self.schema))], names)


def _number(text: str) -> float | None:
    return None if text.strip() in ("?", "") else float(text)


_KINDS = {"numeric": _number, "string": lambda t: None if t.strip() in ("?", "") else t, "date": lambda t: None if t.strip() in ("?", "") else datetime.strptime(t.strip(), "%Y-%m-%d %H-%M-%S")}


def _series(text: str, kinds: list) -> list:
    parts = text.split(":")
    if len(parts) != len(kinds) + 1:
        raise LacunaError(f"a series has {len(parts)} fields in place of {len(kinds) + 1}: {text[:80]}")
    return [*[kind(p) for kind, p in zip(kinds, parts)], [_number(v) for v in parts[-1].split(",")] if parts[-1].strip() else []]


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The store and the non-empty files of a path or URI: one file, or those of a folder but hidden ones."""
    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise LacunaError(f"no file {path}")
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner))
    return store, sorted((f for f in found if f.type == fs.FileType.File and f.size and f.base_name[:1] not in "._"), key=lambda f: f.path)


def _head(store: fs.FileSystem, path: str, encoding: str) -> tuple[list[tuple[str, str]], int]:
    """Attributes of a file and the byte at which its series begin."""
    lines = []
    with io.BufferedReader(store.open_input_file(path), 1 << 16) as file:
        while line := file.readline():
            lines.append(line.decode(encoding))
            if lines[-1].strip() == "@data":
                break
        return header(lines)[0], file.tell()


class TsfSource(DataSource):
    """``spark.read.format("tsf").load(path)``: a file or a folder of files with one header.

    Options: ``value_column`` (series_value), ``encoding`` (iso-8859-1), ``split_bytes``
    (64 MB): a task reads the lines that begin in its range.  Empty fields and ``?`` are
    NULL; malformed headers and lines with other numbers of fields raise.
    """

    @classmethod
    def name(cls) -> str:
        return "tsf"

    def schema(self) -> str:
        store, files = _files(self.options["path"])
        if not files:
            raise LacunaError("no .tsf file to take columns from")
        heads = [_head(store, f.path, self._encoding)[0] for f in files]
        if any(h != heads[0] for h in heads):
            raise LacunaError("files of one folder must have the same attributes")
        return ", ".join([*[f"`{n}` {_TYPES[t]}" for n, t in heads[0]], f"`{self.options.get('value_column', 'series_value')}` array<double>"])

    @property
    def _encoding(self) -> str:
        return self.options.get("encoding", "iso-8859-1")

    def reader(self, schema: StructType) -> TsfReader:
        return TsfReader(schema, self.options["path"], int(self.options.get("split_bytes", 64 << 20)), self._encoding)


def register(spark: SparkSession) -> None:
    """Makes the format ``tsf`` known to the session."""
    spark.dataSource.register(TsfSource)


def write_tsf(df: DataFrame, path: str, value_column: str = "series_value") -> None:
    """A folder of .tsf files, one a task, each with the header; NULL is ``?``.

    Columns but the values become attributes: numbers numeric, times date, others string,
    whose colons and line ends would break the format and raise.
    """
    names = [c for c in df.columns if c != value_column]
    kinds = {c: "numeric" if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal") else "date" if t.startswith("timestamp") else "string" for c, t in df.dtypes}
    head = [*[f"@attribute {c} {kinds[c]}" for c in names], "@data"]

    def text(c: str):
        shown = F.date_format(c, "yyyy-MM-dd HH-mm-ss") if kinds[c] == "date" else F.col(c).cast("string")
        if kinds[c] == "string":
            shown = F.when(shown.rlike("[:\\r\\n]"), F.raise_error(F.lit(f"{c} holds a colon or a line end"))).otherwise(shown)
        return F.coalesce(shown, F.lit("?"))

    values = F.array_join(F.transform(value_column, lambda v: F.coalesce(v.cast("string"), F.lit("?"))), ",")
    lines = df.select(F.concat_ws(":", *[text(c) for c in names], F.coalesce(values, F.lit(""))).alias("value"))

    def with_head(batches):
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(head, batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    lines.mapInArrow(with_head, "value string").write.text(path)


def widen(series: DataFrame, name: str = "series_name", value_column: str = "series_value") -> DataFrame:
    """A column for each series and a row for each position, down to the shortest series."""
    shortest = series.agg(F.min(F.size(value_column))).first()[0] or 0
    names = sorted(r[0] for r in series.select(name).distinct().collect())
    long = series.select(name, F.posexplode(F.slice(value_column, 1, shortest)).alias("i", "v"))
    return long.groupBy("i").pivot(name, names).agg(F.first("v")).orderBy("i")
