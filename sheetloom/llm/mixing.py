"""Mixing sources to target weights by a splitting tree of multivariate-hypergeometric draws.

The documents of a source are permuted by hash and dealt into blocks. What a source's target asks for
is a number of whole passes over its blocks, further whole blocks, and documents of one more block.
These draws of blocks are the colours of an urn: a tree over the output shards halves the shards again and
again and draws how many of each source's blocks go to the left half, so that every shard gets
its exact number of blocks and every source places all of its own. Shards then take
disjoint stretches of a source's draws in permuted order, and put their documents in random order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.numbering import ordered_slots
from ._util import checkpointed, dense_slots, fresh

WORD = r"[^\x20\x09-\x0D]+"
SHARES = (1, 2, 3)
#: Times that a document may be taken.
REPEATS = 3
BLOCK_DOCS = 64
#: Blocks that a first sum of words covers, and salts of a source.
SUPER, SALTS, SPREAD = 1024, 16, 1024


def n_words(text: Column) -> Column:
    """Words of a text, none in a null one."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def keyed_rows(df: DataFrame, seed: int, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, row, doc_id, size, h): keys sort like sources with null last, h is the place in the permutation."""
    return df.select(
        F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1")).alias("key"),
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        n_words(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("h"),
    )


def source_targets(rows: DataFrame, shares: Sequence[float] = SHARES, repeats: int = REPEATS) -> DataFrame:
    """(key, rank, source_size, target): the sum of all sizes, shared by weight among sources in order of their keys.

    No target is above ``repeats`` times its source's size; what is over goes to the others by
    weight, until none is above. Each round brings two sums to the driver.
    """
    sources = rows.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(0))
    sources = ordered_slots(sources, ["one"], ["key"], "rank").drop("one")
    weight = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), (F.col("rank") % len(shares)).cast("int") + 1)
    sources = checkpointed(sources.withColumn("weight", weight))
    most = F.col("source_size").cast("double") * repeats
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = most <= F.lit(level) * F.col("weight")
        got = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if got[0] == full or not got[2]:
            break
        full, level = got[0], (total - repeats * (got[1] or 0)) / got[2]
    return sources.select("key", "rank", "source_size", F.least(most, F.lit(level) * F.col("weight")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number between 0 and 1, both excluded, from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) * 2.0**-53


def hypergeometric(first: Column, second: Column, drawn: Column, *salt: Column) -> Column:
    """How many of ``drawn`` balls, from an urn of ``first`` and ``second`` of two colours, are of the first.

    The largest of log probability plus Gumbel noise over the values that can occur; of these, only
    ones over 12 deviations and 40 from the mean are left out, which double precision cannot tell from impossible.
    """
    a, b, k = (c.cast("double") for c in (first, second, drawn))
    mean = k * a / (a + b)
    width = F.ceil(F.sqrt(mean * (b / (a + b)) * ((a + b - k) / F.greatest(a + b - 1, F.lit(1.0)))) * 12) + 40
    low = F.greatest(F.lit(0).cast("long"), drawn - second, F.floor(mean) - width)
    high = F.least(drawn, first, F.ceil(mean) + width)

    def step(acc: Column, i: Column) -> Column:
        x = i.cast("double")
        log = F.when(i == low, F.lit(0.0)).otherwise(acc["log"] + F.ln((a - x + 1) * (k - x + 1) / (x * (b - k + x))))
        score = log - F.ln(-F.ln(_uniform(*salt, i)))
        return F.struct(log.alias("log"), F.greatest(acc["best"], score).alias("best"), F.when(score > acc["best"], i).otherwise(acc["pick"]).alias("pick"))

    start = F.struct(F.lit(0.0).alias("log"), F.lit(float("-inf")).alias("best"), low.alias("pick"))
    drawn_first = F.aggregate(F.sequence(low, high), start, step, lambda acc: acc["pick"])
    return F.when((first == 0) | (drawn == 0), F.lit(0).cast("long")).when(second == 0, drawn).otherwise(drawn_first)


def _pair_sum(counts: Column) -> Callable[[Column], Column]:
    return lambda i: F.get(counts, i * 2) + F.get(counts, i * 2 + 1)


def _pair_draw(counts: Column, *salt: Column) -> Callable[[Column, Column], Column]:
    """The number k drawn from pair i of the counts, and how many of it are of the pair's first."""
    return lambda k, i: F.struct(k.alias("k"), hypergeometric(F.get(counts, i * 2), F.get(counts, i * 2 + 1), k, *salt, i).alias("x"))


def splitting_tree(counts: DataFrame, n_sources: int, n_shards: int, seed: int) -> DataFrame:
    """(rank, shard, n): how many draws of each source a shard gets; ``counts`` has (rank, n), ranks gapless from 0.

    A node is one row with a count per source. Its left half's number of draws is exact;
    sources share it by halving their list, too, with one draw of two colours for each half.
    No row of documents is looked at, so a node's size is that of the list of sources.
    """
    depth = max(0, (n_sources - 1).bit_length())
    wide = F.array_repeat(F.lit(0).cast("long"), (1 << depth) - n_sources)
    listed = counts.agg(F.sort_array(F.collect_list(F.struct("rank", "n"))).alias("l"), F.sum("n").alias("total"))
    nodes = listed.select(F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), F.concat(F.transform("l", lambda x: x["n"]), wide).alias("c"), "total")
    bound = lambda at: F.floor(F.col("total") * at / n_shards)
    for _ in range((n_shards - 1).bit_length()):
        nodes = nodes.withColumn("mid", F.expr("(lo + hi) div 2")).withColumn(f"s{depth}", F.col("c"))
        for g in range(depth - 1, -1, -1):
            nodes = nodes.withColumn(f"s{g}", F.transform(F.sequence(F.lit(0), F.lit((1 << g) - 1)), _pair_sum(F.col(f"s{g + 1}"))))
        drawn = F.array((bound(F.col("mid")) - bound(F.col("lo"))).cast("long"))
        for g in range(depth):
            one = _pair_draw(F.col(f"s{g + 1}"), F.lit(seed), F.col("lo"), F.col("hi"), F.lit(g))
            drawn = F.flatten(F.transform(F.transform(drawn, one), lambda d: F.array(d["x"], d["k"] - d["x"])))
        nodes = nodes.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, drawn).otherwise(F.col("c")))
        halves = F.array(
            F.struct("lo", F.when(F.col("hi") - F.col("lo") > 1, F.col("mid")).otherwise(F.col("hi")).alias("hi"), F.col("left").alias("c")),
            F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("c", "left", lambda x, y: x - y).alias("c")),
        )
        nodes = nodes.select("total", F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(F.slice(halves, 1, 1))).alias("h")).select("total", "h.*")
    return nodes.select(F.col("lo").alias("shard"), F.posexplode(F.slice("c", 1, n_sources)).alias("rank", "n"))


def _summed_blocks(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, block, passes, rest, whole): the passes over a block, whether one more takes it whole, or else up to ``rest`` words of it."""
    blocks = checkpointed(placed.groupBy("key", "block").agg(F.sum("size").alias("words")).withColumn("super", F.expr(f"block div {SUPER}")))
    upper = blocks.groupBy("key", "super").agg(F.sum("words").alias("above"))
    ahead = Window.partitionBy("key").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.withColumn("above", F.coalesce(F.sum("above").over(ahead), F.lit(0)))
    inside = Window.partitionBy("key", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(upper, ["key", "super"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    blocks = blocks.join(sources.select("key", "source_size", "target", passes.alias("passes")), "key")
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long") - F.col("above") - F.col("before")
    return blocks.select("key", "block", "passes", F.greatest(rest, F.lit(0)).alias("rest"), (rest >= F.col("words")).alias("whole"))


def _fitting(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, block, chosen): rows of a block taken in part, each where it still fits, large ones first."""
    part = blocks.where(~F.col("whole") & (F.col("rest") > 0)).select("key", "block", "rest")
    docs = placed.join(part, ["key", "block"]).groupBy("key", "block", "rest").agg(F.sort_array(F.collect_list(F.struct("size", "h", "row")), asc=False).alias("docs"))
    start = F.struct(F.col("rest").alias("left"), F.array().cast("array<bigint>").alias("rows"))
    take = lambda acc, d: F.when(d["size"] <= acc["left"], F.struct((acc["left"] - d["size"]).alias("left"), F.array_append(acc["rows"], d["row"]).alias("rows"))).otherwise(acc)
    return docs.select("key", "block", F.aggregate("docs", start, take, lambda acc: acc["rows"]).alias("chosen"))  # at most BLOCK_DOCS rows


def plan_mix(df: DataFrame, n_shards: int = 24, shares: Sequence[float] = SHARES, repeats: int = REPEATS, seed: int = 1) -> DataFrame:
    """(row, doc_id, h, size, source_size, target, taken, copies) of every document; copies holds (pass, shard) of each time it is taken.

    Null texts have no words, null sources are a source, the last; a source without words has
    the target 0 and is not taken. A source's taken words differ from its target by less than
    the smallest document of one block that is not taken. Rows alike are documents each; an empty table
    gives no rows. Reruns over the same rows agree, however they are partitioned.
    """
    rows = checkpointed(keyed_rows(df, seed))
    sources = checkpointed(source_targets(rows, shares, repeats))
    placed = dense_slots(rows, ["key"], ["h", "doc_id", "size"], "at", SPREAD)
    placed = checkpointed(placed.withColumn("block", F.expr(f"at div {BLOCK_DOCS}")).drop("at"))
    blocks = checkpointed(_summed_blocks(placed, sources))
    chosen = checkpointed(_fitting(placed, blocks))
    blocks = blocks.join(chosen, ["key", "block"], "left")

    times = F.col("passes") + (F.col("whole") | F.col("chosen").isNotNull()).cast("int")
    draws = blocks.where(times > 0).select("key", "block", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("pass"))
    draws = checkpointed(draws.withColumn("h", F.xxhash64(F.lit(seed), "key", "pass", "block")))
    counts = sources.join(draws.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "left").select("rank", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    split = splitting_tree(counts, sources.count(), n_shards, seed)
    ahead = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long"))).groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("shard", "start"))).alias("starts"))
    starts = checkpointed(sources.select("key", "rank").join(starts, "rank").select("key", F.transform("starts", lambda s: s["start"]).alias("starts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    dealt = dense_slots(draws, ["key"], ["h", "pass", "block"], "draw", SPREAD).withColumn("salt", (F.col("draw") % SALTS).cast("int")).join(starts, ["key", "salt"])
    shard = F.size(F.filter("starts", lambda s: s <= F.col("draw"))) - 1
    dealt = dealt.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("pass", shard.alias("shard")))).alias("copies"))

    blocks = checkpointed(blocks.join(dealt, ["key", "block"], "left"))
    found = placed.join(blocks, ["key", "block"])
    mine = F.filter("copies", lambda c: (c["pass"] <= F.col("passes")) | F.col("whole") | F.coalesce(F.array_contains("chosen", F.col("row")), F.lit(False)))
    found = found.withColumn("copies", F.coalesce(mine, F.array().cast("array<struct<pass:bigint,shard:int>>")))
    salt = F.pmod(F.col("block"), F.lit(SALTS)).cast("int")
    wide = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("rank")
    found = found.withColumn("salt", salt).join(wide, ["key", "salt"])
    return found.select("row", "doc_id", "h", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), "copies")


def mixed(df: DataFrame, n_shards: int = 24, shares: Sequence[float] = SHARES, repeats: int = REPEATS, seed: int = 1) -> DataFrame:
    """(shard, slot, row, doc_id, pass, size) of everything the mix takes; slot numbers a shard's documents in random order, gapless from 0."""
    taken = plan_mix(df, n_shards, shares, repeats, seed).select("row", "doc_id", "size", "h", F.explode("copies").alias("c")).select("row", "doc_id", "size", "h", "c.*")
    taken = checkpointed(taken.withColumn("order", F.xxhash64(F.lit(seed), "shard", "pass", "h")))
    return dense_slots(taken, ["shard"], ["order", "pass", "h", "doc_id", "size", "row"], "slot").select("shard", "slot", "row", "doc_id", "pass", "size")


def write_mix(df: DataFrame, path: str, n_shards: int = 24, shares: Sequence[float] = SHARES, repeats: int = REPEATS, seed: int = 1) -> None:
    """Write whole documents, with all their columns, to one folder per shard in the order of the mix; ``df`` must give the same rows whenever it is read."""
    folder, slot, row, salt = fresh(df, "shard", "slot", "row", "salt")
    order = mixed(df, n_shards, shares, repeats, seed).select(F.col("row").alias(row), F.col("shard").alias(folder), F.col("slot").alias(slot))
    texts = df.withColumn(row, F.monotonically_increasing_id()).join(order, row).drop(row)
    pieces = texts.withColumn(salt, F.col(slot) % SALTS).repartition(folder, salt)
    pieces.sortWithinPartitions(folder, slot).drop(salt).write.partitionBy(folder).parquet(path)


def mix_report(df: DataFrame, n_shards: int = 24, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards of each time a document is taken."""
    return plan_mix(df, n_shards, seed=seed).select("doc_id", "size", "source_size", "target", "taken", F.transform("copies", lambda c: c["shard"]).alias("shards"))
