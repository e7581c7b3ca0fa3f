"""Token-id files: one independent zstandard frame per document, a trailing seek table, per-frame checksums.

Layout of a file::

    zstd frame            ids of document 0, little-endian, with zstd's own content checksum
    ...
    skippable frame       magic 0x184D2A50: b"IDS1", id width, number of documents, per document
                          its id (int64), whether the id is present (uint8) and its number of frames (uint32)
    skippable frame       magic 0x184D2A5E: the seek table of zstd's seekable format - per frame its compressed size,
                          content size and low 32 bits of the content's XXH64; then the number of frames, the
                          descriptor 0x80 and the magic 0x8F92EAB1

Any zstd decoder reads the whole; a reader of single documents takes the tail and then only the wanted frames.
A document over ``FRAME_BYTES`` takes several frames. Files appear under their final name only when complete; names are
unique per attempt and the manifest, written by Spark, names the attempts that count - a lost executor leaves no trace.

Edge cases: a null or empty text is the end id alone; documents that repeat a ``doc_id`` stay, ordered by their first ``PREFIX``
characters and then the text's hash, so that many rows of one id (or of none) still spread over files; a null ``doc_id`` comes first and reads
back as null; an empty table gives no file and no row. Ids are those of the library's default: the string of a special token in a text becomes its id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, new_path, prepare
from .encoding import MEMO_BYTES, encoder, filesystem

IDS_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Content bytes of one frame at most.
FRAME_BYTES = 64 << 20
LEVEL = 1
#: Characters of a text that order documents of one id.
PREFIX = 64


class TokenFileWriter:
    def __init__(self, stream, width: int):
        import zstandard

        self.stream, self.width = stream, width
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.ids: list[int | None] = []
        self.frames: list[int] = []
        self.seeks: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, data: bytes) -> None:
        from xxhash import xxh64_intdigest

        count = 0
        for k in range(0, len(data), FRAME_BYTES):
            part = data[k : k + FRAME_BYTES]
            frame = self.zstd.compress(part)
            self.stream.write(frame)
            self.seeks.append((len(frame), len(part), xxh64_intdigest(part) & 0xFFFFFFFF))
            count += 1
        self.ids.append(doc_id)
        self.frames.append(count)

    def close(self) -> None:
        ids = np.array([0 if x is None else x for x in self.ids], "<i8").tobytes()
        here = np.array([x is not None for x in self.ids], "u1").tobytes()
        head = struct.pack("<4sIQ", b"IDS1", self.width, len(self.ids)) + ids + here + np.array(self.frames, "<u4").tobytes()
        seek = np.array(self.seeks, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.seeks), 0x80, FOOT_MAGIC)
        self.stream.write(struct.pack("<II", IDS_MAGIC, len(head)) + head + struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)


class TokenFileReader:
    """Reads the tail of a file, and then only the frames of the documents asked for."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        start = size - 9 - 12 * n - 8
        self.seeks = np.frombuffer(self._at(start + 8, 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate(([0], np.cumsum(self.seeks[:, 0], dtype=np.int64)))
        at = int(self.offsets[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        head = self._at(at + 8, length)
        mark, width, docs = struct.unpack_from("<4sIQ", head)
        if magic != IDS_MAGIC or mark != b"IDS1":
            raise ValueError("no document ids")
        self.dtype = np.dtype(f"<u{width}")
        ids = np.frombuffer(head, "<i8", docs, 16)
        here = np.frombuffer(head, "u1", docs, 16 + 8 * docs)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(ids, here)]
        self.first = np.concatenate(([0], np.cumsum(np.frombuffer(head, "<u4", docs, 16 + 9 * docs), dtype=np.int64)))

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def read(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document; raises ValueError if a frame doesn't hold what was written."""
        from xxhash import xxh64_intdigest

        a, b = int(self.first[k]), int(self.first[k + 1])
        raw = self._at(int(self.offsets[a]), int(self.offsets[b] - self.offsets[a])) if b > a else b""
        parts, at = [], 0
        for csize, dsize, check in self.seeks[a:b].tolist():
            part = self.zstd.decompress(raw[at : at + csize])
            if len(part) != dsize or xxh64_intdigest(part) & 0xFFFFFFFF != check:
                raise ValueError(f"document {self.doc_ids[k]}: a frame fails its checksum")
            parts.append(part)
            at += csize
        return np.frombuffer(b"".join(parts), self.dtype)

    def read_ids(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        wanted = set(doc_ids)
        for k, doc_id in enumerate(self.doc_ids):
            if doc_id in wanted:
                yield doc_id, self.read(k)


def _writer(folder: str, tokenizer: str, end_id: int, memo_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer, memo_bytes=memo_bytes)
        end = np.array([end_id], enc.dtype).tobytes()
        fs, path = filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.zst"
        out, n_ids = None, 0
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                fs.create_dir(path, recursive=True)
                stream = fs.open_output_stream(f"{path}/.{name}", compression=None)
                out = TokenFileWriter(stream, enc.dtype.itemsize)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), enc.encode(texts)):
                out.add(doc_id, data + end)
                n_ids += len(data) // enc.dtype.itemsize + 1
        if out is not None:
            out.close()
            stream.close()
            fs.move(f"{path}/.{name}", f"{path}/{name}")
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": len(out.ids), "n_ids": n_ids}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Writes ``docs`` in ascending ``doc_id`` order to files in ``folder`` of the shared store; returns the manifest (part, file, n_docs, n_ids)."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_first(), F.substring("text", 1, PREFIX), F.xxhash64("text")
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(map_arrow(dealt, _writer(folder, tokenizer, end_id, memo_bytes), "part int, file string, n_docs bigint, n_ids bigint"), "manifest")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{path}/{row['file']}") as file:
                    source, start = TokenFileReader(file), row["start"]
                    for a in range(0, len(source.doc_ids), 4096):
                        ids, starts, counts, checks = source.doc_ids[a : a + 4096], [], [], []
                        for k in range(a, a + len(ids)):
                            tokens = source.read(k)
                            starts.append(start)
                            counts.append(len(tokens))
                            checks.append(zlib.crc32(tokens.astype("<u4").tobytes()))
                            start += len(tokens)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(checks, pa.int64()), pa.array([row["file"]] * len(ids))],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                        )

    return run


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: its first position in the whole, its ids' number and crc32, its file."""
    rows, start = [], 0
    for r in manifest.orderBy("part").collect():  # one row per file
        rows.append((r.file, start))
        start += r.n_ids
    files = spark.createDataFrame(rows, "file string, start bigint")
    if rows:
        files = files.repartition(len(rows))
    return map_arrow(files, _reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or new_path(spark, "ids")
    return read_token_files(spark, folder, write_token_files(docs, folder, tokenizer, end_id, memo_bytes=memo_bytes))
