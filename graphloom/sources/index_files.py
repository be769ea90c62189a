"""Index files: sections with a checksum each, the state of an index, and what is read in which order.

A build of an index is a folder of tables.  A table is a set of section files of
bounded size, each with the rows of one kind, written by the tasks that hold
them, and a manifest that names them, written when all have ended.  The build
that counts is the one that the newest ``current-<n>`` file names; it appears
by renaming, after everything else, so a save that breaks off changes nothing.

:class:`IndexSource` reads a table with a partition a section, or a few small
ones: a section is checked before any of its rows is given out.  Sections of
other kinds than those that the option ``kinds`` names are not opened.  Filters
are not pushed: with Spark 4.1.2 all scans of one loaded table in a plan share
the state of the last pushed filter, so two filters on one table gave the rows
of one of them twice.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC, VERSION, ORDER_MARK = b"GLIX", 1, 0x01020304
#: Magic, version, order mark, header size, rows, bytes of the body, SHA-256 of the body.
HEADER = struct.Struct("<4sIIIQQ32s")
#: A section ends with the batch that takes it beyond this many bytes in memory.
SECTION_BYTES = 8 << 20
#: Of more sections than that, small ones are read together, up to so many rows at once.
OWN_TASK, TASK_ROWS = 32, 400_000
SECTION_ROW = "section string, kind string, rows long, state string"
MISSING, CORRUPT, VERSION_MISMATCH, STALE, CURRENT = "missing", "corrupt", "version mismatch", "stale", "current"


class IndexFault(ValueError):
    """An index that must not be read; ``state`` says why."""

    def __init__(self, state: str, detail: str):
        super().__init__(f"{state}: {detail}")
        self.state, self.detail = state, detail


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _read(path: str) -> bytes | None:
    files, at = _at(path)
    try:
        with files.open_input_file(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _write(path: str, data: bytes) -> None:
    """A file appears under its name only when it is whole."""
    files, at = _at(path)
    part = f"{at}.part-{uuid.uuid4().hex}"
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(part) as f:
        f.write(data)
    files.move(part, at)


def packed(rows: int, body: bytes) -> bytes:
    return HEADER.pack(MAGIC, VERSION, ORDER_MARK, HEADER.size, rows, len(body), hashlib.sha256(body).digest()) + body


def unpacked(data: bytes | None, what: str) -> tuple[int, bytes]:
    """(rows, body); whatever is wrong with the bytes is an :class:`IndexFault`, the version before all else."""
    if data is None:
        raise IndexFault(CORRUPT, f"{what} is not there")
    if len(data) < 8 or data[:4] != MAGIC:
        raise IndexFault(CORRUPT, f"{what} has no header")
    version = int.from_bytes(data[4:8], "little")
    if version != VERSION:
        raise IndexFault(VERSION_MISMATCH, f"{what} has version {version}, not {VERSION}")
    if len(data) < HEADER.size:
        raise IndexFault(CORRUPT, f"{what} ends in its header")
    _, _, mark, size, rows, length, digest = HEADER.unpack_from(data)
    body = data[HEADER.size :]
    if mark != ORDER_MARK or size != HEADER.size:
        raise IndexFault(CORRUPT, f"{what} has another byte order or header size")
    if length != len(body):
        raise IndexFault(CORRUPT, f"{what} has {len(body)} bytes, not {length}")
    if hashlib.sha256(body).digest() != digest:
        raise IndexFault(CORRUPT, f"{what} differs from its checksum")
    return rows, body


def _manifest(path: str) -> dict:
    rows, body = unpacked(_read(f"{path}/manifest"), f"{path}/manifest")
    found = json.loads(body)
    if rows != len(found["sections"]):
        raise IndexFault(CORRUPT, f"{path}/manifest names {len(found['sections'])} sections, not {rows}")
    return found


@dataclass
class Section(InputPartition):
    name: str
    kind: str | None
    rows: int
    digest: str

    def __init__(self, name: str, kind: str | None, rows: int, digest: str):
        self.name, self.kind, self.rows, self.digest = name, kind, rows, digest


@dataclass
class Several(InputPartition):
    sections: list

    def __init__(self, sections: list):
        self.sections = sections


@dataclass
class Written(WriterCommitMessage):
    sections: list


class SectionReader(DataSourceReader):
    def __init__(self, path: str, sections: list, check: bool, kinds: list | None):
        every = [Section(*s) for s in sections]
        self.path, self.check = path, check
        self.sections = every if kinds is None else [s for s in every if s.kind in kinds]

    def partitions(self):
        """A partition a section; of more than ``OWN_TASK``, small ones share partitions of up to ``TASK_ROWS`` rows."""
        if len(self.sections) <= OWN_TASK or self.check:
            return [Several([s]) for s in self.sections] or [Several([])]
        groups, rows = [], TASK_ROWS
        for s in self.sections:
            if rows + s.rows > TASK_ROWS:
                groups.append([])
                rows = 0
            groups[-1].append(s)
            rows += s.rows
        return [Several(g) for g in groups]

    def _body(self, s: Section) -> bytes:
        data = _read(f"{self.path}/{s.name}")
        rows, body = unpacked(data, s.name)
        if rows != s.rows or hashlib.sha256(body).hexdigest() != s.digest:
            raise IndexFault(CORRUPT, f"{s.name} is not the section of the manifest")
        return body

    def read(self, partition: Several) -> Iterator:
        for s in partition.sections:
            yield from self._rows(s)

    def _rows(self, partition: Section) -> Iterator:
        import pyarrow as pa

        if self.check:
            try:
                self._body(partition)
                state = "ok"
            except IndexFault as e:
                state = str(e)
            yield partition.name, partition.kind, partition.rows, state
            return
        left = partition.rows
        for batch in pa.ipc.open_stream(self._body(partition)):
            left -= batch.num_rows
            yield batch
        if left:
            raise IndexFault(CORRUPT, f"{partition.name} does not hold {partition.rows} rows")


class SectionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, by: str | None, ddl: str):
        self.path, self.by, self.ddl = path, by, ddl

    def write(self, iterator) -> Written:
        import pyarrow as pa
        import pyarrow.compute as pc

        held: dict[str | None, list] = {}
        done = []

        def flush(kind):
            batches = held.pop(kind)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in batches:
                    out.write_batch(b)
            body, rows = sink.getvalue().to_pybytes(), sum(b.num_rows for b in batches)
            name = f"{uuid.uuid4().hex}.section"
            _write(f"{self.path}/{name}", packed(rows, body))
            done.append((name, kind, rows, hashlib.sha256(body).hexdigest()))

        for batch in iterator:
            kinds = batch.column(batch.schema.get_field_index(self.by)) if self.by else None
            for kind in pc.unique(kinds).to_pylist() if self.by else [None]:
                mine = batch if not self.by else batch.filter(pc.is_null(kinds) if kind is None else pc.equal(kinds, kind))
                if mine.num_rows:
                    held.setdefault(kind, []).append(mine)
                    if sum(b.nbytes for b in held[kind]) > SECTION_BYTES:
                        flush(kind)
        for kind in list(held):
            flush(kind)
        return Written(done)

    def commit(self, messages) -> None:
        sections = sorted((s for m in messages if m is not None for s in m.sections), key=lambda s: (s[1] or "", s[0]))
        _write(f"{self.path}/manifest", packed(len(sections), json.dumps({"schema": self.ddl, "by": self.by, "sections": sections}).encode()))

    def abort(self, messages) -> None:
        files, at = _at(self.path)
        for s in (s for m in messages if m is not None for s in m.sections):
            files.delete_file(f"{at}/{s[0]}")


class IndexSource(DataSource):
    """``spark.read.format("code_index").load(table)``; option ``check`` gives the state of each section instead of its rows.

    Written tables take option ``by``, the column whose values part sections.  A
    table is written once: saving under a path that holds a manifest is an error.
    Columns come back as nullable ones.
    """

    @classmethod
    def name(cls) -> str:
        return "code_index"

    @property
    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    @property
    def _check(self) -> bool:
        return self.options.get("check", "false").lower() == "true"

    def schema(self) -> str:
        return SECTION_ROW if self._check else _manifest(self._path)["schema"]

    def reader(self, schema: StructType) -> SectionReader:
        m = _manifest(self._path)
        kinds = json.loads(self.options.get("kinds", "null"))
        if kinds is not None and not m["by"]:
            raise ValueError(f"{self._path} is not parted by a column")
        return SectionReader(self._path, m["sections"], self._check, kinds)

    def writer(self, schema: StructType, overwrite: bool) -> SectionWriter:
        if _read(f"{self._path}/manifest") is not None:
            raise ValueError(f"{self._path} is written already")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return SectionWriter(self._path, self.options.get("by"), ddl)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(IndexSource)
    return spark


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as sections, parted by the values of ``by`` in the tasks that hold them: rows are made once and not shuffled."""
    registered(df.sparkSession)
    w = df.write.format("code_index").mode("append")
    (w.option("by", by) if by else w).save(path)


def read_table(spark: SparkSession, path: str, kinds: Iterable[str | None] | None = None) -> DataFrame:
    """A table, or of one that is parted by a column only the sections with its values ``kinds``."""
    r = registered(spark).read.format("code_index")
    return (r if kinds is None else r.option("kinds", json.dumps(list(kinds)))).load(path)


def _pointers(root: str) -> list[tuple[int, str]]:
    from pyarrow import fs

    files, at = _at(root)
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    names = [f.base_name for f in found if f.base_name.startswith("current-") and f.base_name[8:].isdigit()]
    return sorted((int(n[8:]), f"{root}/{n}") for n in names)


def save(root: str, tables: dict[str, DataFrame]) -> None:
    """A new build of ``tables``; one with a column ``kind`` is parted by it.  The build before is removed when the new one counts.

    One writer at a time: two that end together leave the build of the later rename.
    """
    root = root.rstrip("/")
    before = _pointers(root)
    build = f"build-{uuid.uuid4().hex}"
    started = time.time()
    for name, df in tables.items():
        write_table(df, f"{root}/{build}/{name}", "kind" if "kind" in df.columns else None)
    digests = {name: hashlib.sha256(_read(f"{root}/{build}/{name}/manifest")).hexdigest() for name in tables}
    body = json.dumps({"build": build, "tables": digests, "saved": started}).encode()
    _write(f"{root}/current-{before[-1][0] + 1 if before else 1:08d}", packed(len(tables), body))
    files, at = _at(root)
    for _, old in before:
        try:
            gone = json.loads(unpacked(_read(old), old)[1])["build"]
        except IndexFault:
            continue  # nobody can tell what it named
        files.delete_file(_at(old)[1])
        files.delete_dir(f"{at}/{gone}")


def _current(root: str) -> dict:
    found = _pointers(root.rstrip("/"))
    if not found:
        raise IndexFault(MISSING, f"no index in {root}")
    newest = found[-1][1]
    current = json.loads(unpacked(_read(newest), newest)[1])
    for name, digest in current["tables"].items():
        path = f"{root.rstrip('/')}/{current['build']}/{name}/manifest"
        data = _read(path)
        unpacked(data, path)
        if hashlib.sha256(data).hexdigest() != digest:
            raise IndexFault(CORRUPT, f"{path} is not the manifest of the build")
    return current


def load(spark: SparkSession, root: str, kinds: dict[str, Iterable[str | None]] | None = None) -> dict[str, DataFrame]:
    """The tables of the build that counts; its pointer and manifests are checked here, a section when it is read.

    ``kinds`` names, for some tables, the kinds to read.
    """
    current = _current(root)
    return {name: read_table(spark, f"{root.rstrip('/')}/{current['build']}/{name}", (kinds or {}).get(name)) for name in current["tables"]}


def faults(spark: SparkSession, root: str) -> DataFrame:
    """(table, section, kind, rows, state): sections that differ from their checksum; each is read by a task of its own."""
    current = _current(root)
    parts = [registered(spark).read.format("code_index").option("check", "true").load(f"{root.rstrip('/')}/{current['build']}/{name}").select(F.lit(name).alias("table"), "*") for name in current["tables"]]
    return reduce(DataFrame.union, parts).where("state <> 'ok'")


def state(spark: SparkSession, root: str, files: DataFrame | None = None) -> tuple[str, str]:
    """(state, detail) of an index against the files of a tree (path, size, hash, language, parser_version).

    ``missing``, ``corrupt`` and ``version mismatch`` come first, in this order of
    looking: pointer, manifests, every section.  ``stale`` means that a file was
    added, changed or removed since; without ``files`` that is not looked at.
    """
    from ..operators.compare import file_changes

    try:
        current = _current(root)
    except IndexFault as e:
        return e.state, e.detail
    bad = faults(spark, root).select("section", "state").first()
    if bad:
        return (VERSION_MISMATCH if bad["state"].startswith(VERSION_MISMATCH) else CORRUPT), f"{bad['section']}: {bad['state']}"
    if files is not None:
        if "files" not in current["tables"]:
            return STALE, "the index does not say of which files it is"
        changed = file_changes(load(spark, root)["files"], files).where("change <> 'Unchanged'").first()
        if changed:
            return STALE, f"{changed['change']}: {changed['path']}"
    return CURRENT, ""


def cache(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame] | None:
    """(files, records) of an index, or None where they are missing, damaged or of another version: then everything is read again."""
    if state(spark, root)[0] != CURRENT:
        return None
    tables = load(spark, root)
    return (tables["files"], tables["records"]) if {"files", "records"} <= tables.keys() else None


_ID = "decimal(20,0)"
GRAPH_JSON = (
    f"nodes array<struct<id: {_ID}, kind: string, name: string, qualified_name: string, file: string,"
    " location: struct<file: string, start_line: int, start_col: int, end_line: int, end_col: int>,"
    " language: string, visibility: string, signature: string, container: string>>,"
    f" edges array<struct<id: {_ID}, kind: string, `from`: {_ID}, `to`: {_ID}, confidence: string, label: string>>"
)


def load_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph document: one object with both lists, ids as unsigned numbers.

    Such a document is one JSON value, so one task parses it; text that does not
    parse, and documents without one of the lists, are errors.
    """
    doc = spark.read.schema(GRAPH_JSON).json(path, multiLine=True, mode="FAILFAST")
    try:
        lacking = doc.where("nodes IS NULL OR edges IS NULL").first()
    except (PySparkException, Py4JJavaError) as e:
        raise IndexFault(CORRUPT, f"{path} does not parse") from e
    if lacking:
        raise IndexFault(CORRUPT, f"{path} lacks nodes or edges")

    def signed(c: str):
        return F.when(F.col(c) > 2**63 - 1, F.col(c) - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(F.col(c)).cast("long")

    nodes = doc.select(F.inline("nodes")).withColumn("id", signed("id")).withColumn("language", F.lower("language")).withColumn("visibility", F.lower(F.coalesce("visibility", F.lit("unknown"))))
    e = doc.select(F.inline("edges"))
    return nodes, e.select(signed("id").alias("id"), "kind", signed("from").alias("src"), signed("to").alias("dst"), "confidence", "label")


def exists(path: str) -> bool:
    from pyarrow import fs

    files, at = _at(path)
    return files.get_file_info(at).type != fs.FileType.NotFound


def opened(spark: SparkSession, root: str, build: Callable[[], tuple[DataFrame, DataFrame]], folder: str = ".graphloom") -> tuple[DataFrame, DataFrame, str]:
    """(nodes, edges, from where): the index of a tree, else its graph document, else one at the top, else what ``build`` gives.

    The first that is there is taken: one that is damaged or of another version is
    an error and is not passed over.
    """
    if _pointers(f"{root}/{folder}/index"):
        tables = load(spark, f"{root}/{folder}/index")
        return tables["nodes"], tables["edges"], "index"
    for path in (f"{root}/{folder}/graph.json", f"{root}/graph.json"):
        if exists(path):
            return *load_json(spark, path), path.removeprefix(f"{root}/")
    return *build(), "build"
