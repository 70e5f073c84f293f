"""Loaders by name, and Spark data sources for formats that Spark does not read.

A loader is ``(spark, data_path, predictions_path, **options) -> DataFrame`` of PSM rows with
the canonical columns (``prediction``, ``valid_prediction`` and so on). Built-in ones and one's
own are registered under a name and used alike::

    @loader("my-engine")
    def load(spark, data_path, predictions_path, **options): ...

    psms = load_psms(spark, "my-engine", "run.mgf", "out.txt", masses=masses)

``register_sources`` makes two formats known to ``spark.read``:

* ``psm-ipc``    Arrow IPC files: a partition per run of record batches, found from footers and
                 message headers alone; batches go to Spark as Arrow, not row by row;
* ``psm-mztab``  the PSM section of mzTab files: a partition per byte range of a file, lines
                 belonging to the range they start in; columns as text, by the section's header.

Files are opened through Arrow's file systems, on the executors as on the driver; paths need a
scheme they know (a path without one is local). Planning reads metadata only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spectrafdr.operators.filters import require_columns
from spectrafdr.sources.arrow_blocks import Block, blocks

LOADERS: dict[str, Callable[..., DataFrame]] = {}
# Bytes of text a partition reads, and rows of a partition of record batches.
SPLIT_BYTES = 64_000_000
SPLIT_ROWS = 1_000_000
_READ_BYTES = 4_000_000
_LINES_AT_ONCE = 20_000


def loader(name: str):
    """Register a loader under a name; a name in use is an error."""

    def register(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in LOADERS:
            raise KeyError(f"loader {name!r} is already registered")
        LOADERS[name] = function
        return function

    return register


def load_psms(spark: SparkSession, name: str, data_path: str | list[str], predictions_path: str | None = None,
              **options) -> DataFrame:
    """PSM rows by the loader registered under ``name``; its result is checked for the canonical columns."""
    if name not in LOADERS:
        raise KeyError(f"no loader {name!r}; known: {sorted(LOADERS)}")
    found = LOADERS[name](spark, data_path, predictions_path, **options)
    require_columns(found, ["prediction", "valid_prediction"])
    return found


@loader("beam-csv")
def _beam_csv(spark, data_path, predictions_path, **options):
    from spectrafdr.sources import predictions

    return predictions.load_beam_csv(spark, data_path, predictions_path, **options)


@loader("mztab")
def _mztab(spark, data_path, predictions_path, **options):
    from spectrafdr.sources import predictions

    return predictions.load_mztab(spark, data_path, predictions_path, **options)


@loader("title-tsv")
def _title_tsv(spark, data_path, predictions_path, **options):
    from spectrafdr.sources import predictions

    return predictions.load_title_tsv(spark, data_path, predictions_path, **options)


@loader("saved")
def _saved(spark, data_path, predictions_path=None, **options):
    from spectrafdr.sources import saved

    return saved.load_saved(spark, data_path, **options)


def register_sources(spark: SparkSession) -> None:
    """Make ``psm-ipc`` and ``psm-mztab`` formats of ``spark.read``."""
    for source in (IpcSource, MzTabSource):
        spark.dataSource.register(source)


# --- files ---------------------------------------------------------------------------------


def _system(path: str):
    from pyarrow import fs

    # Hadoop writes one slash after "file:", URIs have three.
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _files(path: str, endings: tuple[str, ...]) -> list[str]:
    """A file, or files of a folder, as paths with their scheme.

    A folder that is named like a file (``run.mztab/part-0``) is one data set of all its
    visible files; of any other folder those with one of the endings are taken.
    """
    from pyarrow import fs

    system, inner = _system(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = [i.path for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File]
    prefix = path.rstrip("/")
    names = [f.rsplit("/", 1)[-1] for f in found]
    whole = prefix.lower().endswith(endings)
    return sorted(f"{prefix}/{n}" for n in names if (n[0] not in "._" if whole else n.lower().endswith(endings)))


def _open(path: str):
    system, inner = _system(path)
    return system.open_input_file(inner)


def _datasets(options: dict, endings: tuple[str, ...]) -> list[list[str]]:
    """Files of every path asked for: option ``path``, or ``paths`` as a JSON list."""
    wanted = json.loads(options["paths"]) if "paths" in options else [options["path"]] if "path" in options else []
    if not wanted:
        raise ValueError("a path is required")
    return [_files(path, endings) for path in wanted]


def _each(function: Callable, items: list) -> list:
    """Small reads of metadata, some at a time."""
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(function, items))


# --- Arrow IPC -------------------------------------------------------------------------------


@dataclass
class IpcPartition(InputPartition):
    """Neighbouring record batches of one file."""

    path: str
    first: int
    stop: int
    start: int


class IpcSource(DataSource):
    """Arrow IPC files; columns are the union over all files, plus ``file`` and ``row_number``."""

    @classmethod
    def name(cls) -> str:
        return "psm-ipc"

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        out = from_arrow_schema(_ipc_schema(_ipc_files(self.options)))
        return out.add("file", T.StringType()).add("row_number", T.LongType())

    def reader(self, schema: T.StructType) -> IpcReader:
        return IpcReader(self.options, schema)


def _ipc_files(options: dict) -> list[str]:
    return [file for files in _datasets(options, (".ipc", ".arrow", ".feather")) for file in files]


def _ipc_schema(paths: list[str]) -> pa.Schema:
    def one(path: str) -> pa.Schema:
        with _open(path) as file:
            return pa.ipc.open_file(file).schema.remove_metadata()

    found = _each(one, paths)
    return pa.unify_schemas(found) if found else pa.schema([])


def _ipc_blocks(path: str) -> list[Block]:
    with _open(path) as file:
        return blocks(file)


class IpcReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.paths = _ipc_files(options)
        self.rows = int(options.get("splitRows", SPLIT_ROWS))
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[IpcPartition]:
        out = []
        for path, found in zip(self.paths, _each(_ipc_blocks, self.paths), strict=True):
            own: list[Block] = []
            for block in found:
                if own and block.start + block.rows - own[0].start > self.rows:
                    out.append(IpcPartition(path, own[0].number, block.number, own[0].start))
                    own = []
                own.append(block)
            if own:
                out.append(IpcPartition(path, own[0].number, own[-1].number + 1, own[0].start))
        return out

    def read(self, partition: IpcPartition) -> Iterator[pa.RecordBatch]:
        at = partition.start
        with _open(partition.path) as file:
            reader = pa.ipc.open_file(file)
            for number in range(partition.first, partition.stop):
                batch = reader.get_batch(number)
                n, names = batch.num_rows, set(batch.schema.names)
                made = {"file": pa.array([partition.path] * n, pa.string()), "row_number": pa.array(range(at, at + n), pa.int64())}
                columns = [
                    made[f.name] if f.name in made
                    else batch.column(f.name).cast(f.type) if f.name in names else pa.nulls(n, f.type)
                    for f in self.schema
                ]
                at += n
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


# --- mzTab -----------------------------------------------------------------------------------


@dataclass
class MzTabPartition(InputPartition):
    """A byte range of one file, and the columns of its PSM section."""

    path: str
    start: int
    stop: int
    columns: tuple[str, ...]


class MzTabSource(DataSource):
    """PSM rows of mzTab files as text columns; ``null`` cells are NULL. ``file`` names the file."""

    @classmethod
    def name(cls) -> str:
        return "psm-mztab"

    def schema(self) -> T.StructType:
        names: dict[str, None] = {}
        for files in _datasets(self.options, (".mztab",)):
            names |= dict.fromkeys(_section_columns(files))
        out = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return out.add("file", T.StringType())

    def reader(self, schema: T.StructType) -> MzTabReader:
        return MzTabReader(self.options, schema)


def _section_columns(files: list[str]) -> tuple[str, ...]:
    """Columns of a data set of one or more files; the first header counts."""
    return next((found for found in map(_psm_header, files) if found), ())


def _psm_header(path: str) -> tuple[str, ...]:
    """Columns of the PSM section, from the file's head: the section's first line names them."""
    with _open(path) as file:
        for _, line in _lines(file, 0, file.size()):
            if line.startswith(b"PSH\t"):
                return tuple(line.decode().rstrip("\r\n").split("\t")[1:])
    return ()


def _lines(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """``place, line`` of the lines that start within a byte range, reading on to the last one's end."""
    file.seek(max(0, start - 1))
    at, held, skip = max(0, start - 1), b"", start > 0
    while True:
        read = file.read(_READ_BYTES)
        data = held + read
        begin = 0
        while (end := data.find(b"\n", begin)) >= 0:
            place = at + begin
            line, begin = data[begin : end + 1], end + 1
            if skip:  # the line that ends at or after the byte before the range
                skip = False
                continue
            if place >= stop:
                return
            yield place, line
        if not read:
            if begin < len(data) and not skip and at + begin < stop:
                yield at + begin, data[begin:]
            return
        at, held = at + begin, data[begin:]
        if at >= stop and not skip:
            return


class MzTabReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.datasets = _datasets(options, (".mztab",))
        self.bytes = int(options.get("splitBytes", SPLIT_BYTES))
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> list[MzTabPartition]:
        out = []
        for files in self.datasets:
            columns = _section_columns(files)
            for path in files:
                with _open(path) as file:
                    size = file.size()
                out += [MzTabPartition(path, a, min(size, a + self.bytes), columns) for a in range(0, size, self.bytes)]
        return out

    def read(self, partition: MzTabPartition) -> Iterator[pa.RecordBatch]:
        place = {name: i for i, name in enumerate(partition.columns)}
        cells: list[list[str]] = []
        with _open(partition.path) as file:
            for _, line in _lines(file, partition.start, partition.stop):
                if line.startswith(b"PSM\t"):
                    cells.append(line.decode().rstrip("\r\n").split("\t")[1:])
                if len(cells) == _LINES_AT_ONCE:
                    yield self._batch(cells, place, partition.path)
                    cells = []
        if cells:
            yield self._batch(cells, place, partition.path)

    def _batch(self, cells: list[list[str]], place: dict[str, int], path: str) -> pa.RecordBatch:
        def column(name: str) -> pa.Array:
            if name == "file":
                return pa.array([path] * len(cells), pa.string())
            at = place.get(name)
            values = [c[at] if at is not None and at < len(c) else None for c in cells]
            return pa.array([None if v == "null" else v for v in values], pa.string())

        return pa.RecordBatch.from_arrays([column(n) for n in self.names], self.names)
