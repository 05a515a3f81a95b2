"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import shared_folder

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of the rows that go to a Python worker at once; Spark's own limit is 64 MB, for each task in the executor and in the worker.
BATCH_BYTES = 4 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder that the cluster names.

    Meanwhile rows go to Python in batches of BATCH_BYTES, unless the session sets a limit of its own.
    """
    shared_folder(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key in conf.getAll:
        return df.checkpoint()
    conf.set(key, str(BATCH_BYTES))
    try:
        return df.checkpoint()
    finally:
        conf.unset(key)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, made different from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dense_slots(df: DataFrame, keys: list[str], order: list[str], out: str, spread: int = 64) -> DataFrame:
    """Number the rows of each key from 0 without gaps.

    Rows of a key are dealt over ``spread`` buckets by a hash of ``order``, numbered
    inside each bucket, and moved up by the sizes of the buckets before it, so a key
    that holds most of the rows is still numbered by many tasks. ``df`` is read
    twice and must give the same rows both times (checkpoint it first).
    """
    bucket, row, before, b, *own = fresh(df, "bucket", "row", "before", "b", *[f"k{i}" for i in range(len(keys))])
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias(before))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col(bucket).alias(b), F.coalesce(F.sum(before).over(ahead), F.lit(0)).alias(before))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    on = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own)] + [F.col(bucket) == F.col(b)]
    return (
        df.withColumn(row, F.row_number().over(inside))
        .join(sizes, on)
        .withColumn(out, (F.col(before) + F.col(row) - 1).cast("long"))
        .drop(bucket, b, row, before, *own)
    )


def paired_blocks(blocks: DataFrame, key: str, parts: str, block: str, content: str) -> DataFrame:
    """(left, right): every block of a key with every block of it, itself included, both ways.

    ``parts`` is the number of the key's blocks. They meet in a grid of about as many cells
    as the key has blocks, at most as there are shuffle partitions, so no task gets all of a
    large key and each block is sent to no more cells than that needs.
    """
    most = int(np.ceil(np.sqrt(shuffle_parts(blocks))))
    several = blocks.where(F.col(parts) > 1).withColumn("grid", F.least(F.ceil(F.sqrt(parts)), F.lit(most)).cast("long"))
    several = several.select(F.col(key).alias("key"), "grid", (F.col(block) % F.col("grid")).alias("cell"), F.col(content).alias("own"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid") - 1))
    left = several.select("key", F.col("cell").alias("r"), others.alias("c"), F.col("own").alias("left"))
    right = several.select("key", others.alias("r"), F.col("cell").alias("c"), F.col("own").alias("right"))
    single = blocks.where(F.col(parts) == 1).select(F.col(content).alias("left"), F.col(content).alias("right"))
    return left.join(right, ["key", "r", "c"]).select("left", "right").unionByName(single)


def compact(df: DataFrame) -> DataFrame:
    """An eighth of the shuffle partitions, for rows of a few bytes about documents of kilobytes."""
    return df.coalesce(max(1, shuffle_parts(df) // 8))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and the offset of each text; null texts are empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    if raw is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where their texts pass ``most`` bytes; one row is never cut."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(size):
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (node, root), root the smallest node reached.

    Alternates large-star and small-star steps until the edges stay the same; each
    step is an aggregation and a join, so a node with very many edges is only a
    skewed join, and the driver sees two numbers a round.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e if not large else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))

    def tidy(e: DataFrame) -> DataFrame:
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return checkpointed(compact(e.where("u > v").distinct()))

    now = tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
        now = tidy(stars(tidy(stars(now, True)), False))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
