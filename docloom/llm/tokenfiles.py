"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of a run of documents, one after the other, in blocks of 256 ids::

    magic    8 bytes
    blocks   each: minimum u32, width u8, exceptions u8,
             the ids less the minimum packed at ``width`` bits,
             exceptions: places u8 each, then the bits above ``width`` as u32 each
    docs     doc_id i64 each, null flag u8 each, number of ids u32 each
    index    start of each block, u64 each
    footer   starts of docs and index u64, numbers of documents, ids and blocks u64, magic

The width of a block is what its 90th percentile needs, so a few rare ids do not widen the rest.
The last block is filled up with its last id. All numbers are little-endian.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, partitions, small_batches, stored, trimmed
from .words import TextEncoder, byte_pieces

MAGIC, BLOCK, PERCENTILE = b"PFORIDS1", 256, 0.9
_FOOTER = struct.Struct("<QQQQQ8s")


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of blocks of :data:`BLOCK` ids each, and where each starts; ``ids`` must fill whole blocks."""
    rows = ids.astype(np.uint32).reshape(-1, BLOCK)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    at = np.partition(rest, rank, axis=1)[:, rank].astype(np.int64)
    widths = np.frexp(at.astype(np.float64))[1].astype(np.int64)  # bits of the percentile: exact below 2**53
    above = (rest.astype(np.uint64) >> widths[:, None].astype(np.uint64)).astype(np.uint32)
    odd = above > 0
    counts = odd.sum(axis=1)
    sizes = 6 + BLOCK * widths // 8 + 5 * counts
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros((len(rows), 6), np.uint8)
    head[:, :4] = np.ascontiguousarray(low, "<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = widths, counts
    out[starts[:, None] + np.arange(6)] = head
    for width in np.unique(widths[widths > 0]):
        chosen = np.flatnonzero(widths == width)
        bits = np.unpackbits(np.ascontiguousarray(rest[chosen], "<u4").view(np.uint8).reshape(len(chosen), BLOCK, 4), axis=2, bitorder="little", count=int(width))
        packed = np.packbits(bits.reshape(len(chosen), -1), axis=1, bitorder="little")
        out[starts[chosen][:, None] + 6 + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(odd)
    if len(block):
        nth = np.arange(len(block)) - np.searchsorted(block, block)
        base = starts[block] + 6 + BLOCK * widths[block] // 8
        out[base + nth] = place
        high = np.ascontiguousarray(above[block, place], "<u4").view(np.uint8).reshape(-1, 4)
        out[(base + counts[block] + 4 * nth)[:, None] + np.arange(4)] = high
    return out, starts


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts``."""
    low = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4").reshape(-1).astype(np.uint32)
    widths, counts = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    values = np.zeros((len(starts), BLOCK), np.uint32)
    for width in np.unique(widths[widths > 0]):
        chosen = np.flatnonzero(widths == width)
        packed = data[starts[chosen][:, None] + 6 + np.arange(BLOCK * width // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(chosen), BLOCK, width)
        wide = np.packbits(bits, axis=2, bitorder="little")
        full = np.zeros((len(chosen), BLOCK, 4), np.uint8)
        full[:, :, : wide.shape[2]] = wide
        values[chosen] = full.reshape(len(chosen), -1).view("<u4")
    block = np.repeat(np.arange(len(starts)), counts)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
        base = starts[block] + 6 + BLOCK * widths[block] // 8
        high = np.ascontiguousarray(data[(base + counts[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        values[block, data[base + nth]] |= (high.astype(np.uint64) << widths[block].astype(np.uint64)).astype(np.uint32)
    return (values + low[:, None]).reshape(-1)


class Writer:
    """Writes one file; ids are held only up to a few blocks."""

    def __init__(self, out):
        self._out, self._at, self._starts = out, len(MAGIC), []
        self._held: list[bytes] = []
        self._bytes = self.ids = 0
        self._docs: list[tuple[int | None, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append((doc_id, len(ids) // 4))
        self._held.append(ids)
        self._bytes += len(ids)
        self.ids += len(ids) // 4
        if self._bytes >= BLOCK * 4 * 256:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        data = b"".join(self._held)
        whole = len(data) - len(data) % (BLOCK * 4)
        if last and whole < len(data):
            data += data[-4:] * ((BLOCK * 4 - (len(data) - whole)) // 4)
            whole = len(data)
        if whole:
            blocks, starts = encode_blocks(np.frombuffer(data, "<u4", whole // 4))
            self._starts += (starts + self._at).tolist()
            self._out.write(blocks.tobytes())
            self._at += len(blocks)
        self._held, self._bytes = [data[whole:]], len(data) - whole

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        self._flush(last=True)
        docs = self._at
        ids = np.array([d if d is not None else 0 for d, _ in self._docs], "<i8").tobytes()
        ids += np.array([d is None for d, _ in self._docs], np.uint8).tobytes() + np.array([n for _, n in self._docs], "<u4").tobytes()
        self._out.write(ids)
        self._out.write(np.array(self._starts, "<u8").tobytes())
        self._out.write(_FOOTER.pack(docs, docs + len(ids), len(self._docs), self.ids, len(self._starts), MAGIC))
        return len(self._docs), self.ids


class Reader:
    """Reads a file; any block can be read alone through the index."""

    def __init__(self, file):
        self._file = file
        size = file.seek(0, io.SEEK_END) if hasattr(file, "readinto") else file.size()
        file.seek(size - _FOOTER.size)
        docs, index, count, self.ids, blocks, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        file.seek(docs)
        table = file.read(count * 13)
        known = np.frombuffer(table, np.uint8, count, count * 8)
        self.doc_ids = [int(d) if not null else None for d, null in zip(np.frombuffer(table, "<i8", count), known, strict=True)]
        self.lengths = np.frombuffer(table, "<u4", count, count * 9).astype(np.int64)
        file.seek(index)
        self._starts = np.append(np.frombuffer(file.read(blocks * 8), "<u8"), np.uint64(docs)).astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` up to ``last``."""
        self._file.seek(int(self._starts[first]))
        data = np.frombuffer(self._file.read(int(self._starts[last] - self._starts[first])), np.uint8)
        return decode_blocks(data, self._starts[first:last] - self._starts[first]) if last > first else np.zeros(0, np.uint32)

    def documents(self, step: int = 256):
        """(doc_id, ids as little-endian bytes) of all documents, some blocks in memory at a time."""
        held, blocks, total = b"", 0, len(self._starts) - 1
        for doc_id, n in zip(self.doc_ids, self.lengths, strict=True):
            while len(held) < n * 4:
                held += self.blocks(blocks, min(blocks + step, total)).astype("<u4").tobytes()
                blocks = min(blocks + step, total)
            yield doc_id, held[: n * 4]
            held = held[n * 4 :]


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of the file system that Spark takes it to be on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    name = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    if name.startswith("file:"):
        name = "file://" + name.removeprefix("file:").removeprefix("//")
    return "s3" + name.removeprefix("s3a") if name.startswith("s3a://") else name


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encodes whole texts and writes them as files in ascending doc_id order; returns the manifest.

    The manifest (file_no, path, n_docs, n_tokens; in a table of the shared folder) names the files
    of the attempts that succeeded, each file under a name of its own, so that a lost or
    repeated task leaves nothing wrong. Null ids come first, ties are in order of a hash of the
    text; null texts are the end id alone; an empty table gives no files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = _qualified(spark, folder or fresh_path(spark, "token-files"))
    tie = F.xxhash64("text")
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, end, out = TextEncoder.of_tokenizer(tokenizer_path, byte_pieces), np.array([end_id], "<u4").tobytes(), None
        number = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids = found.tobytes() + end
                if out is None:
                    system, place = _opened(folder)
                    system.create_dir(place, recursive=True)
                    name = f"part-{number:06d}-{uuid.uuid4().hex}.pfor"
                    out = system.open_output_stream(f"{place}/{name}")
                    writer = Writer(out)
                writer.add(doc_id, ids)
        if out is not None:
            count, total = writer.close()
            out.close()
            row = [[number], [f"{folder}/{name}"], [count], [total]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["file_no", "path", "n_docs", "n_tokens"])

    return stored(ranged.mapInArrow(trimmed(run), "file_no long, path string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from the files; on request ids.

    The driver reads the manifest, one row for each file, for the files' starts.
    """
    spark = manifest.sparkSession
    files, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r["file_no"]):
        files.append((row["path"], start))
        start += row["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids

        def batch_of(rows):
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, place = _opened(path)
                rows = []
                with system.open_input_file(place) as file:
                    for doc_id, ids in Reader(file).documents():
                        row = (doc_id, at, len(ids) // 4, zlib.crc32(ids))
                        rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int64)) if with_ids else row)
                        at += len(ids) // 4
                        if len(rows) >= (256 if with_ids else 20_000):
                            yield batch_of(rows)
                            rows = []
                yield batch_of(rows)

    paths = spark.createDataFrame(files, "path string, start long")
    return paths.repartition(max(1, len(files))).mapInArrow(trimmed(run), schema)
