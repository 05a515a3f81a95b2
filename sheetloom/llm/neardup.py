"""Near-duplicate vectors by NN-descent.

A neighbour graph is seeded by random-projection leaves and refined by joining the
neighbours of neighbours. Every link met on the way joins components, whatever the lists
hold. Vectors whose lists are full of links have their lists enlarged to their whole
component, and go on looking for as many neighbours outside it. A sample of queries is
compared with all rows to audit the recall query by query; a poor audit adds deeper rounds
of seeds and refines again, and if it stays poor all pairs of vectors are compared.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import checkpointed, components, dense_slots, paired_blocks, shuffle_parts

BLOCK = 512
#: Queries of the audit: at most this many vectors are sent to every executor.
AUDIT = 256


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))
    return x


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, vec): each vector divided by its norm, in double precision as bytes; unusable vectors have null vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, dims = [], []
            for v in batch.column("v").to_pylist():
                x = np.array([np.nan] if not v else [np.nan if c is None else c for c in v], np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    big = np.abs(x).max()
                    ok = bool(np.isfinite(x).all()) and big > 0
                    x = x / big if ok else x  # so that squares neither overflow nor vanish
                    vecs.append((x / np.sqrt((x * x).sum())).tobytes() if ok else None)
                dims.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["id", "dim", "vec"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, dim int, vec binary")


def _top(node: np.ndarray, other: np.ndarray, sim: np.ndarray, inside: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k most similar different others of each node inside its component, and as many outside."""
    order = np.lexsort((-sim, other, node))
    node, other, sim, inside = (x[order] for x in (node, other, sim, inside))
    fresh = np.concatenate([[True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])])[: len(node)]
    node, other, sim, inside = (x[fresh] for x in (node, other, sim, inside))
    order = np.lexsort((-sim, inside, node))
    node, other, sim, inside = (x[order] for x in (node, other, sim, inside))
    first = np.concatenate([[True], (node[1:] != node[:-1]) | (inside[1:] != inside[:-1])])[: len(node)]
    place = np.arange(len(node)) - np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))
    return tuple(x[place < k] for x in (node, other, sim, inside))


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a symmetric matrix of links: links (i, j) that connect all that its links connect, and a label of each row's component."""
    label = np.arange(len(hit))
    left = hit.any(1)
    a, b = [], []
    while left.any():
        first = int(np.argmax(left))
        left[first] = False
        todo = [first]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(hit[i] & left)
            if len(new):
                left[new] = False
                label[new] = first
                a.append(np.full(len(new), i))
                b.append(new)
                todo += new.tolist()
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b), label) if a else (none, none, label)


#: `joins` marks links that join components; the other rows are candidates for the lists, inside a component or not.
_EDGE = "node long, other long, sim double, inside boolean, joins boolean"


def _edges(node, other, sim, inside, joins: bool = False) -> pa.RecordBatch:  # noqa: ANN001
    flags = (np.broadcast_to(np.asarray(x, bool), len(node)) for x in (inside, joins))
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x)) for x in (node, other, sim)), *(pa.array(np.array(x)) for x in flags)], ["node", "other", "sim", "inside", "joins"])


def _candidates(found: DataFrame) -> DataFrame:
    return found.where("not joins").select("node", "other", "sim", "inside", F.lit(False).alias("old"))


def seed_edges(points: DataFrame, k: int, trees: int, rows: int, first: int, least: float, leaf: int = 256) -> DataFrame:
    """Neighbours inside the leaves of random-projection trees.

    A leaf is named by the signs of ``log2(rows / leaf)`` projections; leaves that come
    out larger are cut by a further projection's order into blocks of BLOCK vectors.
    All links of a block count for the components; of candidates, each vector gets k from
    its component, as far as ``root`` and the block tell it, and k from others.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, rows) / leaf))))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = _unit(own.column("vec").to_pylist())
                for t in range(first, first + trees):
                    planes = np.random.default_rng([t, int(dim)]).normal(size=(int(dim), depth + 1))
                    y = x @ planes
                    code = (y[:, :depth] > 0) @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, np.int32)), own.column("dim"), pa.array(code.astype(np.int64)), pa.array(y[:, -1]), own.column("node"), own.column("root"), own.column("vec")],
                        ["tree", "dim", "code", "along", "node", "root", "vec"],
                    )

    named = checkpointed(points.mapInArrow(name, "tree int, dim int, code long, along double, node long, root long, vec binary"))
    # numbered by a hash inside the leaf, so that a crowded one is dealt over blocks; `along` sorts what fits in one
    placed = dense_slots(named, ["tree", "dim", "code"], ["along", "node"], "slot", spread=8)
    blocks = placed.groupBy("tree", "dim", "code", F.floor(F.col("slot") / BLOCK).alias("block")).agg(F.collect_list(F.struct("node", "root", "vec")).alias("points"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for points_ in batch.column("points"):
                ids, root = (points_.values.field(c).to_numpy() for c in ("node", "root"))
                x = _unit(points_.values.field("vec").to_pylist())
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                i, j, label = _forest(sim >= least)
                yield _edges(ids[i], ids[j], sim[i, j], True, True)
                inside = (root[:, None] == root) | (label[:, None] == label)
                m = min(k, len(ids) - 1)
                for within in (True, False) if m else ():
                    own = np.where(inside == within, sim, -2)
                    best = np.argpartition(-own, m - 1, axis=1)[:, :m]
                    score = np.take_along_axis(own, best, 1)
                    found = score > -2
                    yield _edges(np.repeat(ids, found.sum(1)), ids[best[found]], score[found], within)

    return blocks.select("points").mapInArrow(join, _EDGE)


def best_edges(edges: DataFrame, k: int) -> DataFrame:
    """(node, other, sim, inside, old): the k most similar different others of each node inside its component, and as many outside.

    ``edges`` has the same columns. They are dealt out by node once, for the merging of
    equal ones and the ranking alike.
    """
    best = edges.repartition(shuffle_parts(edges), "node").groupBy("node", "other").agg(F.max("sim").alias("sim"), F.bool_or("inside").alias("inside"), F.bool_or("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("node", "inside").orderBy(F.desc("sim"), "other"))
    return best.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def placed_in(graph: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges of a graph, with ``inside`` as the components of ``roots`` (node, root) now say."""
    rows = graph.drop("inside").join(roots, "node", "left").join(roots.select(F.col("node").alias("other"), F.col("root").alias("_o")), "other", "left")
    return rows.select("node", "other", "sim", F.coalesce(F.col("root") == F.col("_o"), F.lit(False)).alias("inside"), F.lit(True).alias("old"))


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) of the components after further links, for every node that links."""
    links = links.select(F.col("node").alias("a"), F.col("other").alias("b"))
    if roots is not None:
        links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = checkpointed(components(links))
    return checkpointed(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()))  # a root is no node there


def rooted(points: DataFrame, roots: DataFrame) -> DataFrame:
    return points.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def refine(graph: DataFrame, points: DataFrame, k: int, least: float) -> DataFrame:
    """Edges between the neighbours of each node that would enter a neighbour's list, and links that join components.

    ``points`` has the components as ``root``, which ``graph`` was made with.
    """
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim", "inside")
    rank = F.row_number().over(Window.partitionBy("node", "inside").orderBy(F.desc("sim"), "other"))
    both = graph.drop("old").unionByName(back).repartition(shuffle_parts(graph), "node")
    near = both.groupBy("node", "other", "inside").agg(F.max("sim").alias("sim")).withColumn("_r", rank).where(F.col("_r") <= 2 * k).select("node", "other")
    part = lambda inside: F.col("inside") if inside else ~F.col("inside")
    worst = graph.groupBy("node").agg(*[F.when(F.count_if(part(x)) >= k, F.min(F.when(part(x), F.col("sim")))).otherwise(F.lit(-2.0)).alias(c) for c, x in (("worst", False), ("worst_in", True))])
    known = points.select("node", "root", "vec").join(worst, "node", "left").select(F.col("node").alias("other"), "root", "vec", *[F.coalesce(c, F.lit(-2.0)).alias(c) for c in ("worst", "worst_in")])
    local = near.join(known, "other").groupBy("node").agg(F.collect_list(F.struct(F.col("other").alias("node"), "root", "vec", "worst", "worst_in")).alias("points"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, links = [], []
            for points_ in batch.column("points"):
                ids, root, worst_, worst_in = (points_.values.field(c).to_numpy() for c in ("node", "root", "worst", "worst_in"))
                raw = points_.values.field("vec").to_pylist()
                if len({len(r) for r in raw}) == 1:
                    x = _unit(raw)
                    sim = x @ x.T
                    np.fill_diagonal(sim, -3)
                    inside = root[:, None] == root
                    i, j = np.nonzero(sim > np.where(inside, worst_in[:, None], worst_[:, None]))
                    found.append((ids[i], ids[j], sim[i, j], inside[i, j]))
                    i, j, _ = _forest((sim >= least) & ~inside)
                    links.append((ids[i], ids[j], sim[i, j], np.zeros(len(i), bool)))
            if found:
                yield _edges(*_top(*(np.concatenate(c) for c in zip(*found)), k))
                yield _edges(*(np.concatenate(c) for c in zip(*links)), True)

    return local.select("points").mapInArrow(join, _EDGE)


def _linked_blocks(least: float):  # noqa: ANN202
    """Of two blocks of one component: how many of the right block each vector of the left one links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts = [], []
            for left, right in zip(batch.column("left"), batch.column("right")):
                ids, other = left.values.field("node").to_numpy(), right.values.field("node").to_numpy()
                copies = right.values.field("copies").to_numpy()
                hit = _unit(left.values.field("vec").to_pylist()) @ _unit(right.values.field("vec").to_pylist()).T >= least
                hit &= ids[:, None] != other
                nodes.append(ids)
                counts.append(hit @ copies)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(counts))], ["node", "n"])

    return run


def exact_links(points: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, n_links to other vectors) and (node, root) by comparing all pairs of vectors of one length, block by block.

    Blocks meet in a grid of about as many cells as there are shuffle partitions, so that no
    key holds more than its share of the block pairs.
    """
    grid = int(np.ceil(np.sqrt(shuffle_parts(points))))
    placed = dense_slots(points.select("dim", "node", "vec", "copies"), ["dim"], ["node"], "slot", spread=64)
    block = F.floor(F.col("slot") / BLOCK).alias("block")
    blocks = checkpointed(placed.groupBy("dim", block).agg(F.collect_list(F.struct("node", "vec", "copies")).alias("points")))
    cell, others = F.col("block") % grid, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long")))
    left = blocks.select("dim", cell.alias("r"), others.alias("c"), F.col("points").alias("left"))
    right = blocks.select("dim", others.alias("r"), cell.alias("c"), F.col("points").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("left"), batch.column("right")):
                ids, other = (x.values.field("node").to_numpy() for x in (a, b))
                hit = _unit(a.values.field("vec").to_pylist()) @ _unit(b.values.field("vec").to_pylist()).T >= least
                hit &= ids[:, None] != other
                n = len(ids)
                both = np.zeros((n + len(other),) * 2, bool)
                both[:n, n:], both[n:, :n] = hit, hit.T
                i, j, _ = _forest(both)
                name = np.concatenate([ids, other])
                some = np.flatnonzero(hit.any(1))
                count = hit[some] @ b.values.field("copies").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([ids[some], name[i]]), np.concatenate([np.zeros(len(some), np.int64), name[j]]), np.concatenate([count, np.zeros(len(i), np.int64)]))], ["node", "other", "n"])

    found = checkpointed(left.join(right, ["dim", "r", "c"]).select("left", "right").mapInArrow(run, "node long, other long, n long"))
    counts = checkpointed(found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n_links")))
    return counts, merged(None, found.where("n = 0"))


def audit(points: DataFrame, found: DataFrame, least: float, few: int = 10, queries: int = AUDIT) -> float:
    """The recall of ``found`` (node, n_links), measured by comparing a bounded sample of vectors with all rows.

    It is the mean over the sampled vectors that have links, each counting once however many
    it has, or that over the vectors with at most ``few`` links, if it is worse. Half of the
    sample are vectors found to have links, so that it holds some where links are rare.
    """
    linked = points.join(found.where("n_links > 0").select("node"), "node", "left_semi")
    halves = [x.orderBy(F.xxhash64("node")).select("node", "vec").limit(queries // 2) for x in (points, linked)]
    sample = halves[0].unionByName(halves[1]).distinct().collect()  # bounded by `queries`
    ids = np.array([r["node"] for r in sample], np.int64)
    raw = [bytes(r["vec"]) for r in sample]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            vecs, node, copies = batch.column("vec").to_pylist(), batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            sizes = np.array([len(v) for v in vecs])
            for size in np.unique(sizes):
                mine, theirs = [i for i, v in enumerate(raw) if len(v) == size], np.flatnonzero(sizes == size)
                if mine:
                    hit = _unit([raw[i] for i in mine]) @ _unit([vecs[i] for i in theirs]).T >= least
                    total[mine] += (hit & (ids[mine][:, None] != node[theirs])) @ copies[theirs]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "true"])

    true = points.mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    share = F.least(F.col("true"), F.coalesce("n_links", F.lit(0))) / F.col("true")
    row = true.where(F.col("true") > 0).join(found, "node", "left").agg(F.avg(share).alias("all"), F.avg(F.when(F.col("true") <= few, share)).alias("few")).first()
    return min((x for x in (row["all"], row["few"]) if x is not None), default=1.0)


def link_counts(points: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(node, n_links to other vectors): exact inside every component of ``roots`` (node, root)."""
    members = checkpointed(roots.join(points, "node").select("root", "node", "vec", "copies"))
    parts = checkpointed(members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")))
    placed = dense_slots(members, ["root"], ["node"], "slot", spread=8).join(parts, "root")
    blocks = placed.groupBy("root", "parts", F.floor(F.col("slot") / BLOCK).alias("block")).agg(F.collect_list(F.struct("node", "vec", "copies")).alias("points"))
    both = paired_blocks(checkpointed(blocks), "root", "parts", "block", "points")
    counts = both.mapInArrow(_linked_blocks(least), "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))
    return checkpointed(counts)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, k: int = 10, trees: int = 4, rounds: int = 4, recall: float = 0.97) -> DataFrame:
    """Per row: id, n_links (other rows with cosine of at least ``least``), component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different lengths never link. Equal directions are one point
    with copies. Every link met joins components, however full the lists are; inside a component every
    pair is compared in double precision, block by block, so lists that links fill
    up are enlarged without a limit and counts there are exact. ``component_id``
    is the smallest id; rows that repeat an id are rows of their own. Null ids never
    name a component that has another.
    """
    rows = checkpointed(unit_vectors(df, id_col, vec_col))
    usable = rows.where("vec is not null")
    node = F.xxhash64("vec").alias("node")
    points = checkpointed(usable.groupBy("vec").agg(F.first("dim").alias("dim"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id")).select(node, "dim", "vec", "copies", "least_id"))
    n = points.count()
    roots, graph, seeds = None, None, 0
    for attempt in range(4):
        more = trees << attempt  # as many again as were built so far, and more
        start = points.withColumn("root", F.col("node")) if roots is None else rooted(points, roots)
        found = checkpointed(seed_edges(start, k, more, n, seeds, least))
        seeds += more
        roots = merged(roots, found.where("joins"))
        candidates = _candidates(found)
        graph = checkpointed(best_edges(placed_in(candidates if graph is None else graph.drop("old").unionByName(candidates.drop("old")), roots), k))
        for _ in range(rounds // 2 if attempt == 0 else 1):
            # two rounds at a time over the same components, as merging them takes as long as several rounds
            links, settled, seen = None, False, rooted(points, roots)
            for _ in range(2):
                found = checkpointed(refine(graph, seen, k, least))
                links = found.where("joins") if links is None else links.unionByName(found.where("joins"))
                graph = checkpointed(best_edges(graph.withColumn("old", F.lit(True)).unionByName(_candidates(found)), k))
                settled = graph.where("not old").count() <= 0.002 * n * k
                if settled:
                    break
            joined = bool(links.head(1))
            if joined:
                roots = merged(roots, links)
                graph = checkpointed(best_edges(placed_in(graph, roots), k))
            elif settled:
                break
        counts = link_counts(points, roots, least)
        got = audit(points, counts, least, k) if n > 1 else 1.0
        logging.getLogger(__name__).info("recall %.3f after %d trees", got, seeds)
        if got >= recall:
            break
    else:
        counts, roots = exact_links(points, least)
    named = points.select("node", "copies", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "root").select(F.col("node").alias("_node"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("node")).join(named, F.col("node") == F.col("_node"), "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
