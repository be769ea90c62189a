"""Token-id output in patched frame-of-reference blocks.

File format (``.pfor``, all integers little-endian)::

    magic "PFB1"
    blocks, one after another:
        u32 minimum, u16 values, u8 width, u8 0, u16 exceptions, u16 0,
        packed values (width bits each, most significant bit first, padded to a
        byte), exception positions (u16 each), exception high parts (u32 each)
    footer:
        u64 offset of every block, then i64 id and u64 length of every document
    trailer: u64 footer offset, u64 blocks, u64 documents, u64 values,
        u32 values in a block, magic "PFB1"

A block holds the differences from its minimum at the smallest width that
covers a chosen percentile of them.  A larger difference keeps its low bits in
place; its position and the bits above go to the exception list.  The index of
block starts lets a reader fetch any range of ids without the rest.

Null text counts as empty (the end id alone).  A null id is written as the
smallest 64-bit integer and comes first; rows with the same id follow one
another in the order of a hash of their text, equal rows one after the other.
Very long texts are written whole, a segment at a time.  Columns other than id
and text are left out.  An empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BLOCK = 1024
PERCENTILE = 90.0
#: Ids gathered before blocks are cut: the memory of a writer or reader.
SEGMENT = 256 * BLOCK
MAGIC = b"PFB1"
NULL_ID = -(2**63)
HEAD = struct.Struct("<IHBBHH")
TRAIL = struct.Struct("<QQQQI4s")


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Rows of unsigned integers as rows of bytes, ``bits`` bits a value."""
    rows, n = values.shape
    if bits == 0:
        return np.zeros((rows, 0), np.uint8)
    wide = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(rows, n, 4), axis=2)
    return np.packbits(wide[:, :, 32 - bits :].reshape(rows, n * bits), axis=1)


def _unpack(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    rows = raw.shape[0]
    if bits == 0:
        return np.zeros((rows, n), np.uint32)
    narrow = np.unpackbits(raw, axis=1)[:, : n * bits].reshape(rows, n, bits)
    wide = np.zeros((rows, n, 32), np.uint8)
    wide[:, :, 32 - bits :] = narrow
    return np.packbits(wide, axis=2).reshape(rows, n * 4).view(">u4").astype(np.uint32)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of ``block`` ids each; the last one may be shorter."""
    out: list[bytes] = []
    full = len(ids) // block * block
    parts = [ids[:full].reshape(-1, block)] if full else []
    if full < len(ids):
        parts.append(ids[full:].reshape(1, -1))
    for rows in parts:
        low = rows.min(axis=1)
        delta = (rows - low[:, None]).astype(np.uint32)
        n = rows.shape[1]
        at = min(n - 1, max(0, int(np.ceil(percentile / 100 * n)) - 1))
        top = np.partition(delta, at, axis=1)[:, at]
        bits = np.where(top > 0, np.floor(np.log2(np.maximum(top, 1))).astype(int) + 1, 0)
        done: list[bytes] = [b""] * len(rows)
        for w in np.unique(bits):
            which = np.nonzero(bits == w)[0]
            mine = delta[which]
            packed = _pack(mine & np.uint32((1 << int(w)) - 1), int(w))
            over = (mine >> np.uint32(w)) > 0 if w < 32 else np.zeros_like(mine, bool)
            for k, i in enumerate(which):
                pos = np.nonzero(over[k])[0]
                done[i] = HEAD.pack(int(low[i]), n, int(w), 0, len(pos), 0) + packed[k].tobytes() + pos.astype("<u2").tobytes() + (mine[k][pos] >> np.uint32(w)).astype("<u4").tobytes()
        out += done
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of blocks, in order."""
    heads = [HEAD.unpack_from(b) for b in blocks]
    out: list[np.ndarray | None] = [None] * len(blocks)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault((h[1], h[2]), []).append(i)
    for (n, w), which in groups.items():
        size = (n * w + 7) // 8
        raw = np.frombuffer(b"".join(blocks[i][HEAD.size : HEAD.size + size] for i in which), np.uint8).reshape(len(which), size)
        values = _unpack(raw, n, w)
        for k, i in enumerate(which):
            low, _, _, _, e, _ = heads[i]
            if e:
                at = HEAD.size + size
                pos = np.frombuffer(blocks[i], "<u2", e, at)
                values[k, pos] |= np.frombuffer(blocks[i], "<u4", e, at + 2 * e) << np.uint32(w)
            out[i] = values[k] + np.uint32(low)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class PforWriter:
    """Streams documents into one file; memory is bounded by ``SEGMENT``."""

    def __init__(self, sink, block: int = BLOCK, percentile: float = PERCENTILE):
        self.sink, self.block, self.percentile = sink, block, percentile
        self.buffer = bytearray()
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.lengths: list[int] = []
        self.at, self.total = 0, 0
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.sink.write(b)
        self.at += len(b)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.buffer += ids
        if len(self.buffer) >= 4 * SEGMENT:
            self._flush(len(self.buffer) // (4 * self.block) * 4 * self.block)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(bytes(self.buffer[:n]), "<u4")
        del self.buffer[:n]
        self.total += len(ids)
        for i in range(0, len(ids), SEGMENT):
            for b in encode_blocks(ids[i : i + SEGMENT], self.block, self.percentile):
                self.offsets.append(self.at)
                self._put(b)

    def close(self) -> None:
        if self.buffer:
            self._flush(len(self.buffer))
        foot = self.at
        self._put(np.array(self.offsets, "<u8").tobytes())
        self._put(np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes())
        self._put(TRAIL.pack(foot, len(self.offsets), len(self.docs), self.total, self.block, MAGIC))


class PforReader:
    """Random access to the ids of a file by way of its block index."""

    def __init__(self, source, size: int):
        self.source = source
        foot, blocks, docs, self.total, self.block, magic = TRAIL.unpack(self._get(size - TRAIL.size, TRAIL.size))
        if magic != MAGIC:
            raise ValueError("not a PFB1 file")
        raw = self._get(foot, size - TRAIL.size - foot)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(foot)).astype(np.int64)
        self.docs = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        self.lengths = np.frombuffer(raw, "<u8", docs, 8 * (blocks + docs)).astype(np.int64)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; reads no other blocks."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block + 1
        raw = self._get(int(self.starts[a]), int(self.starts[b] - self.starts[a]))
        cuts = (self.starts[a : b + 1] - self.starts[a]).tolist()
        return decode_blocks([raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)])[start - a * self.block : stop - a * self.block]

    def documents(self):
        """(id, length, crc32) of each document, reading a segment at a time."""
        ends = np.cumsum(self.lengths)
        at, held = 0, b""
        for doc, n, end in zip(self.docs.tolist(), self.lengths.tolist(), ends.tolist(), strict=True):
            crc, left = 0, n
            while left:
                if not held:
                    stop = min(self.total, (at // self.block * self.block) + SEGMENT)
                    held = memoryview(self.ids(at, stop).astype("<u4").tobytes())
                take = min(left, len(held) // 4)
                crc = zlib.crc32(held[: 4 * take], crc)
                held = held[4 * take :]
                at += take
                left -= take
            assert at == end
            yield doc, n, crc


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_pfor(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, end_id: int | None = END_ID, partitions: int | None = None) -> DataFrame:
    """Write the ids of all rows under ``path`` in ascending order of id.

    Returns the manifest (file_no, file, n_docs, n_ids); it lists the files of
    the attempts that Spark committed, so files of lost tasks are never read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    tok = tokenizer_file or bpe.tokenizer_path(TOKENIZER)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        coder, writer, sink = bpe.batch_coder(tok), None, None
        no = TaskContext.get().partitionId()
        name = f"part-{no:06d}-{uuid.uuid4().hex}.pfor"
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                files, at = _fs(path)
                files.create_dir(at, recursive=True)
                sink = files.open_output_stream(f"{at}/{name}")
                writer = PforWriter(sink)
            for doc, ids in zip(b.column(0).to_pylist(), coder.encode(b.column(1)), strict=True):
                writer.add(doc, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int32()), "file": [name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    n = partitions or common.width(spark)
    # rows that share an id, or lack one, are spread and ordered by a hash of their text
    order = ("id", F.xxhash64("text"))
    manifest = src.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(write, "file_no int, file string, n_docs long, n_ids long")
    return common.written(manifest, "pfor-manifest")


def read_pfor(spark: SparkSession, path: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, from the files.

    The driver holds one row of the manifest a file, no row a document.
    """
    files = sorted((tuple(r) for r in manifest.select("file_no", "file", "n_ids").collect()))
    starts, before = [], 0
    for _, name, n in files:
        starts.append((name, before))
        before += n
    schema = "file string, before long"
    todo = spark.createDataFrame(starts, schema)
    todo = todo.repartition(max(1, len(starts)))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fsys, at = _fs(path)
                with fsys.open_input_file(f"{at}/{name}") as f:
                    rows: list[tuple] = []
                    for doc, n, crc in PforReader(f, f.size()).documents():
                        rows.append((None if doc == NULL_ID else doc, start, n, crc))
                        start += n
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["id", "start", "n_tokens", "ids_crc32"])

    return todo.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def op1_pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "pfor")
    manifest = write_pfor(common.read_table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return read_pfor(spark, path, manifest)
