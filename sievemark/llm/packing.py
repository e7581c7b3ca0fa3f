"""Best-fit packing of token pieces into sequences of fixed length, planned over the histogram of lengths.

A document's ids are the tokenizer's for the whole text and the end id. A document of more than ``limit`` tokens is cut into pieces of
``limit`` tokens of which the first may be shorter; any other is one piece. Only the number of pieces of each length
reaches the driver (``limit`` numbers at most). There, best fit in decreasing length runs over counts: sequences with equal room are
one run, and a step puts a number of equal pieces into each sequence of a run. Pieces then take planned slots by joining
on their rank within their length.

Ranks need no shuffle of ids: a task ranks its own pieces as it encodes, and the pieces of a length in earlier tasks, a prefix
sum over one number per task and length, come first. A length that holds most pieces is spread like any other.

Size of the plan: a length splits at most one run and adds at most three, so there are at most 3 x limit runs, and a run takes part in at most
sqrt(2 x limit) steps, as the lengths in a sequence differ from step to step: for 1,024 tokens below 140,000 steps (5.6 MB) whatever the
number of documents; some 3,000 in practice.

Edge cases: a null or empty text is the end id alone; a null ``doc_id`` and rows that repeat an id keep their pieces; an empty
table gives no row. Other columns, whatever their names, are not read. Reruns over the same files give the same packing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .encoding import encoder

LIMIT = 1024
#: Bytes of the encoder's memo: nothing else of size is in this operator's workers.
MEMO_BYTES = 128 << 20
RANK_BITS = 44


class Plan(NamedTuple):
    """Steps in order of (length, first rank): pieces of ``length`` from rank ``first`` on fill sequences from ``sequence`` on, ``each``
    of them side by side from offset ``at``."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    at: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by their rank within their length."""
        # Ranks stay below 2^44, so that (length, rank) is one number.
        step = np.searchsorted(self.length << RANK_BITS | self.first, length << RANK_BITS | rank, side="right") - 1
        inside = rank - self.first[step]
        return self.sequence[step] + inside // self.each[step], self.at[step] + inside % self.each[step] * length


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> Plan:
    """Best fit in decreasing length of ``counts`` pieces of each length into sequences of ``limit`` places."""
    steps: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, number of sequences)
    rooms: list[int] = []
    made = 0

    def leave(room: int, first: int, n: int) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= limit:
            raise ValueError(f"a piece of {length} tokens")
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[k]
            else:
                room, first, n = limit, made, -(-left // (limit // length))
                made += n
            most = room // length
            for each, some in ((most, min(n, left // most)), (left % most, 1)):
                if each and some and n and left >= each and (each == most or left < most):
                    steps.append((length, rank, each, first, limit - room))
                    if room > each * length:
                        leave(room - each * length, first, some)
                    rank, left, first, n = rank + each * some, left - each * some, first + some, n - some
            if n:
                leave(room, first, n)
    steps.sort()
    return Plan(*np.array(steps, np.int64).reshape(-1, 5).T, made)


def cut(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    first = (n - 1) % limit + 1
    return [(0, first), *((k, limit) for k in range(first, n, limit))]


def _cutter(tokenizer: str, end_id: int, limit: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer, memo_bytes=MEMO_BYTES)
        part = TaskContext.get().partitionId()
        seen = [0] * (limit + 1)
        for batch in batches:
            owner, piece, starts, lengths, ranks, checks, kept = [], [], [], [], [], [], []
            for k, data in enumerate(enc.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids = np.append(np.frombuffer(data, enc.dtype).astype("<u4"), np.uint32(end_id))
                for j, (start, length) in enumerate(cut(len(ids), limit)):
                    own = ids[start : start + length].tobytes()
                    owner.append(k)
                    piece.append(j)
                    starts.append(start)
                    lengths.append(length)
                    ranks.append(seen[length])
                    checks.append(zlib.crc32(own))
                    seen[length] += 1
                    if with_ids:
                        kept.append(own)
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(checks, pa.int64()), "part": pa.array([part] * len(owner), pa.int32()), "rank": pa.array(ranks, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _slots(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; ``with_ids`` adds its ids as little-endian
    unsigned 32-bit integers in ``ids``, which :func:`sequences` puts together."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint" + ", ids binary" * with_ids
    pieces = materialize(map_arrow(slim, _cutter(tokenizer, end_id, limit, with_ids), schema), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    plan = best_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit)  # one row a length: limit rows at most
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    before = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # Merged at every size: one row a task and length, which grows with the input.
    ranked = pieces.join(before.hint("merge"), (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "p", "l", "before")
    placed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return map_arrow(ranked, _slots(plan), f"{placed}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces) of each sequence of a packing with ids: ids as ``pack`` keeps them, pieces as (offset, doc_id, piece, start, length).

    A group is one sequence, so it is bounded by the limit.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    found = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return found.select("sequence_id", "n_tokens", joined.alias("ids"), F.transform("p", lambda x: F.struct(x["offset"], x["doc_id"], x["piece"], x["start"], x["length"])).alias("pieces"))
