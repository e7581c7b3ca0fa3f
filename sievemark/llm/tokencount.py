"""Token counts of flat, unindexed token files by a scan for the end-of-document id.

A flat file is nothing but ids. It is cut into blocks of fixed size, wherever documents begin and end; each block is searched
at once (a vectorised comparison) for the end id. A prefix scan over a file's blocks stitches the cuts: the running count of
separators numbers the documents, the running maximum of separator positions tells where a document that spans blocks began.

Edge cases: an empty file or table gives no row; ids after a file's last end id are one more document with ``ended`` false; a
null or empty text is a document of no tokens; rows that repeat are counted one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, new_path, prepare
from .encoding import encoder, filesystem

#: Ids of one block.
BLOCK_IDS = 4 << 20


def _flat_writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, literal=True)
        end = np.array([end_id], enc.dtype).tobytes()
        fs, path = filesystem(folder)
        name, stream, at = f"flat-{uuid.uuid4().hex}.bin", None, 0
        for batch in batches:
            if not len(batch):
                continue
            if stream is None:
                fs.create_dir(path, recursive=True)
                stream = fs.open_output_stream(f"{path}/{name}", compression=None)
            for data in enc.encode([t or "" for t in batch.column("text").to_pylist()]):
                stream.write(data + end)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([name] * len(batch)), pa.array(range(at, at + len(batch)), pa.int64())], names=["doc_id", "file", "place"])
            at += len(batch)
        if stream is not None:
            stream.close()

    return run


def write_flat_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes documents to flat files in ``folder``, one per task and without a shuffle; returns which document stands where: (doc_id, file, place)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialize(map_arrow(slim, _flat_writer(folder, tokenizer, end_id), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, file string, place bigint"), "places")


def _blocks(folder: str, names: list[str], width: int, block_ids: int) -> list[tuple[str, int, int]]:
    fs, path = filesystem(folder)
    sizes = {i.path.rsplit("/", 1)[-1]: i.size for i in fs.get_file_info([f"{path}/{n}" for n in names])}
    return [(n, at, min(block_ids, sizes[n] // width - at)) for n in names for at in range(0, sizes[n] // width, block_ids)]


def _search(folder: str, width: int, end_id: int):
    dtype = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{path}/{row['file']}") as file:
                    file.seek(row["at"] * width)
                    ids = np.frombuffer(file.read(row["n"] * width), dtype)
                ends = np.flatnonzero(ids == end_id) + row["at"]
                lengths = np.diff(ends, prepend=row["at"] - 1) - 1  # the first one counts from the block's start
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["at"]], pa.int64()), pa.array([row["at"] + row["n"]], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))],
                    names=["file", "at", "upto", "n_ends", "last_end", "lengths"],
                )

    return run


def scan_flat_files(spark: SparkSession, folder: str, names: list[str], end_id: int, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, place, n_tokens, ended) of every document of the files; end ids are not counted."""
    prepare(spark)
    blocks = spark.createDataFrame(_blocks(folder, names, width, block_ids), "file string, at bigint, n bigint")
    if names:
        blocks = blocks.repartition(max(1, min(blocks.count(), 4096)))
    found = map_arrow(blocks, _search(folder, width, end_id), "file string, at bigint, upto bigint, n_ends bigint, last_end bigint, lengths array<bigint>")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file")
    stitched = found.select(
        "file",
        "at",
        "lengths",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("first_place"),
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("previous"),
        F.when(F.col("at") == F.max("at").over(last), F.col("upto") - 1 - F.coalesce("last_end", F.max("last_end").over(before), F.lit(-1))).alias("rest"),
        "n_ends",
    )
    whole = stitched.select("file", "at", "first_place", "previous", F.posexplode("lengths").alias("k", "length")).select(
        "file",
        (F.col("first_place") + F.col("k")).alias("place"),
        (F.col("length") + F.when(F.col("k") == 0, F.col("at") - 1 - F.col("previous")).otherwise(0)).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    cut = stitched.where("rest > 0").select("file", (F.col("first_place") + F.col("n_ends")).alias("place"), F.col("rest").alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(cut)


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, n_tokens): documents are encoded to flat files, and the files alone are counted."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "flat")
    places = write_flat_files(docs, folder, tokenizer, end_id)
    names = [r.file for r in places.select("file").distinct().orderBy("file").collect()]  # one per task that wrote
    counted = scan_flat_files(spark, folder, names, end_id, encoder(tokenizer, literal=True).dtype.itemsize, block_ids)
    # Both sides have a row per document: merged at every size, never broadcast.
    return places.join(counted.hint("merge"), ["file", "place"]).select("doc_id", "n_tokens")
