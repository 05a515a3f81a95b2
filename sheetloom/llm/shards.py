"""Sharding by histogram sort.

Rows are ordered by the hash of their text (equal texts lie together), then by a hash
of doc_id, then by a row number. Splitters between shards are found by counting exact
bytes below candidate keys, narrowing the candidates around each target until the
bytes between two of them meet the tolerance, and only then rows are exchanged, once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import checkpointed, dense_slots, fresh

LEVELS = ("h_text", "h_doc", "row")


@dataclass(frozen=True)
class Probe:
    """Keys that share ``fixed`` on the first levels, and ``high`` above ``shift`` on the next; ``below`` bytes lie under them."""

    fixed: tuple[int, ...] = ()
    shift: int = 64
    high: int = 0
    below: int = field(default=0, compare=False)

    def holds(self) -> Column:
        column = F.col(LEVELS[len(self.fixed)])
        cond = F.lit(True) if self.shift == 64 else F.shiftright(column, self.shift) == self.high
        for name, value in zip(LEVELS, self.fixed):
            cond = (F.col(name) == value) & cond
        return cond


def _above(key: tuple[int, ...], inclusive: bool) -> Column:
    """Rows whose key is above ``key``, or equal where ``inclusive``."""
    cond = F.lit(inclusive)
    for name, value in reversed(list(zip(LEVELS, key))):
        cond = (F.col(name) > value) | ((F.col(name) == value) & cond)
    return cond


def keyed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32 and the three sort keys; null texts count no bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h_text"),
        F.xxhash64(F.col(id_col)).alias("h_doc"),
    ).withColumn("row", F.monotonically_increasing_id())


def splitters(keyed: DataFrame, n_shards: int, tolerance: float = 0.0005, bits: int = 10) -> list[tuple[tuple[int, ...], bool]]:
    """Lower bounds of shards 1 to n - 1, each a key and whether it belongs to the shard.

    Each round counts bytes under at most ``2**bits`` candidates per open splitter and
    brings those counts to the driver. A splitter is closed when the keys around its
    target hold at most ``tolerance`` of a shard's bytes, or one row.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    goals = [total * j / n_shards for j in range(1, n_shards)]
    probes = [Probe()] * len(goals)
    done: dict[int, tuple[tuple[int, ...], bool]] = {}
    while total and len(done) < len(goals):
        active = sorted({probes[j] for j in range(len(goals)) if j not in done}, key=lambda p: (p.fixed, p.shift, p.high))
        which, sub = F.lit(None).cast("struct<p:int,v:bigint,k:bigint>"), None
        for i, p in enumerate(active):
            column = F.col(LEVELS[len(p.fixed)])
            sub = F.struct(F.lit(i).alias("p"), F.shiftright(column, max(0, p.shift - bits)).alias("v"), column.alias("k"))
            which = F.when(p.holds(), sub).otherwise(which)
        counted = keyed.select(which.alias("w"), "size").where("w is not null").groupBy("w.p", "w.v")
        rows = counted.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("w.k").alias("lo"), F.max("w.k").alias("hi")).collect()  # at most 2**bits rows a splitter
        by = {i: sorted((r for r in rows if r["p"] == i), key=lambda r: r["v"]) for i in range(len(active))}
        for j, goal in enumerate(goals):
            if j in done:
                continue
            p = probes[j]
            below = p.below
            for r in by[active.index(p)]:
                if below + r["bytes"] > goal or r is by[active.index(p)][-1]:
                    break
                below += r["bytes"]
            if r["n"] == 1 or r["bytes"] <= tolerance * total / n_shards:
                near_start = goal - below <= below + r["bytes"] - goal
                done[j] = ((*p.fixed, r["lo"]), True) if near_start else ((*p.fixed, r["hi"]), False)
            elif r["lo"] == r["hi"]:
                probes[j] = Probe((*p.fixed, r["lo"]), 64, 0, below)
            else:
                probes[j] = Probe(p.fixed, max(0, p.shift - bits), r["v"], below)
    return [done[j] for j in sorted(done)]


def shard_by_bytes(df: DataFrame, n_shards: int = 24, tolerance: float = 0.0005, spread: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (always null under this law) of every row.

    Shards differ by at most a tolerance and a row; copies of a text share a shard
    unless a splitter falls among them, so a text that holds a third of all bytes is
    split. Rows alike in all columns are told apart by row number. No rows: no shards.
    """
    keyed = checkpointed(keyed_rows(df))
    shard = F.lit(0)
    for key, inclusive in splitters(keyed, n_shards, tolerance):
        shard = shard + _above(key, inclusive).cast("int")
    dealt = dense_slots(keyed.withColumn("shard", shard), ["shard"], list(LEVELS), "slot", spread)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, n_shards: int = 24, tolerance: float = 0.0005) -> None:
    """Write whole documents to one folder per shard, after one exchange of the texts.

    All rows and columns stay, null texts too; the folders are called ``shard=``, with
    underscores before it where the documents have such a column.
    """
    keyed = checkpointed(keyed_rows(df))
    shard = F.lit(0)
    for key, inclusive in splitters(keyed, n_shards, tolerance):
        shard = shard + _above(key, inclusive).cast("int")
    # the columns of the documents travel in one, so that no name of theirs meets the keys
    (folder,) = fresh(df, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.struct(*df.columns).alias("own"), F.xxhash64(text).alias("h_text"), F.xxhash64(F.col("doc_id")).alias("h_doc")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("shard", shard).withColumn("salt", F.pmod("h_doc", F.lit(16)))
    rows.repartition("shard", "salt").select("own.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)
