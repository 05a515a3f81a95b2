"""Best-fit packing of tokenized documents into sequences of a fixed length.

Only the histogram of piece lengths, at most one number per length, reaches the
driver. It is packed there in runs of equal lengths, and every piece finds its place
from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import checkpointed, dense_slots, fresh, slices, text_buffers
from .bpe import ByteWordTable, spaced_pieces

PLACES = ["size", "first", "n", "sequence", "offset"]


def token_pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every row of documents.

    A text's ids are followed by ``end_id``, so a null or empty text is one token
    long. Of longer documents the first piece takes what full pieces leave.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ByteWordTable(path)
        for part in slices(batches, "text", 1 << 20):
            data, offsets = text_buffers(part.column("text"))
            words, first = spaced_pieces(data, offsets)
            ids, before = table.ids(words)
            bounds = before[first]
            rows, starts, lengths, sums = [], [], [], []
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                head = len(own) % capacity or capacity
                for start in (0, *range(head, len(own), capacity)):
                    stop = head if start == 0 else start + capacity
                    rows.append(row)
                    starts.append(start)
                    lengths.append(stop - start)
                    sums.append(zlib.crc32(own[start:stop].tobytes()))
            rows = np.array(rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(rows)),
                    pa.array((np.arange(len(rows)) - np.searchsorted(rows, rows)).astype(np.int32)),
                    *(pa.array(x, pa.int64()) for x in (starts, lengths, sums)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan_places(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows of PLACES: pieces ``first`` to ``first + n - 1`` of one size lie at ``offset`` of the sequences from ``sequence`` on.

    Sizes above a third of the capacity are matched greedily, the largest with the
    largest that fits beside it, at most two to a sequence. Smaller sizes, falling,
    go to the smallest gap that holds them. Work grows with the number of different
    sizes and gaps, not with the number of pieces.
    """
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] += n
    used = [0] * (capacity + 1)
    places: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def put(size: int, n: int, sequence: int, offset: int) -> None:
        places.append((size, used[size], n, sequence, offset))
        used[size] += n
        left[size] -= n

    def leave(gap: int, n: int, sequence: int) -> None:
        if n and gap:
            gaps.setdefault(gap, []).append((n, sequence))

    third = capacity // 3
    for size in range(capacity, third, -1):
        while left[size]:
            mate = next((m for m in range(min(size, capacity - size), third, -1) if left[m]), 0)
            n = left[size] // 2 if mate == size else min(left[size], left[mate]) if mate else left[size]
            if mate == size and not n:
                mate, n = next((m for m in range(size - 1, third, -1) if left[m]), 0), 1
            put(size, n, sequences, 0)
            if mate:
                put(mate, n, sequences, size)
            leave(capacity - size - mate, n, sequences)
            sequences += n
    for size in range(third, 0, -1):
        while left[size]:
            gap = min((g for g in gaps if g >= size), default=0)
            if gap:
                n, sequence = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            else:
                gap, n, sequence = capacity, max(1, left[size] // (capacity // size)), sequences
                sequences += n
            each = min(gap // size, left[size])
            filled = min(n, left[size] // each)
            for i in range(each):
                put(size, filled, sequence, capacity - gap + i * size)
            leave(gap - each * size, filled, sequence)
            leave(gap, n - filled, sequence + filled)
    return np.array(sorted(places), np.int64).reshape(-1, len(PLACES))


def pack(pieces: DataFrame, capacity: int = 1024, spread: int = 64) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` from 1 to ``capacity``.

    ``pieces`` is read three times: pass a checkpoint. Rows that are alike get places
    of their own.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per length
    places = plan_places(counts, capacity)
    size, first, _, sequence, offset = places.T
    columns, (rank_col,) = pieces.columns, fresh(pieces, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = size * (1 << 44) + first
        for batch in batches:
            rank = batch.column(rank_col).to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() * (1 << 44) + rank, side="right") - 1
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], [*columns, "sequence_id", "offset"])

    ranked = dense_slots(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], rank_col, spread)
    return ranked.mapInArrow(place, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenize documents and pack their pieces; see token_pieces and pack."""
    return pack(checkpointed(token_pieces(df, path, capacity, end_id)), capacity)
