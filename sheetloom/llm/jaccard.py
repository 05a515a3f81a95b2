"""Jaccard join of word n-gram sets over count vectors.

The shingles of a set are hashed into groups. Sets that link differ in so few shingles
that at least one group is the same in both, so the groups' contents are the leaves
that sets are indexed under; points in one leaf are their counts per coordinate. The
overlap of two points is at most the sum of coordinate minima, crowded leaves are
searched through a tree of bounding boxes with that bound, and the pairs that survive
are verified on the sets themselves. A shingle in which two sets differ spoils one group
at most, so linked sets share many leaves; pairs that share fewer are left out before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import WHITE, checkpointed, compact, components, dense_slots, fresh, paired_blocks, shuffle_parts, slices, text_buffers

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
COORDINATES = 128
#: Leaves up to this size give all their pairs; larger ones are searched block by block.
SMALL_LEAF = 16
#: Up to this many document ids are sent to every executor (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Sets of a component that are compared with as many others at once when links are counted.
BLOCK = 64
#: Members of a crowded leaf in a block: of those outside its largest component, and of all.
MINORS, MEMBERS = 64, 256
#: So many blocks of a leaf by as many meet in one cell.
CELL = 4


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a public finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, letters A-Z lowered, and the number of words before each text."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    plain = ~WHITE[data]
    first = plain.copy()
    first[1:] &= ~plain[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = plain[begins]
    packed = data[plain]
    kept = np.flatnonzero(first[plain])
    before = np.searchsorted(np.flatnonzero(first), offsets)
    if not len(kept):
        return np.zeros(0, np.uint64), before
    lengths = np.diff(np.append(kept, len(packed)))
    weight = mix(np.arange(1, lengths.max() + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    place = np.arange(len(packed)) - np.repeat(kept, lengths)
    sums = np.add.reduceat(weight[place] * (packed.astype(np.uint64) + np.uint64(1)), kept)
    return mix(sums + lengths.astype(np.uint64) * GOLDEN), before


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; of fewer words, the whole sequence as one."""
    words, before = word_hashes(data, offsets)
    weight = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    grams = np.zeros(0, np.uint64)
    if len(words) >= n:
        total = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            total += words[i : len(words) - n + 1 + i] * weight[i]
        grams = mix(total)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * weight[: b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield grams[:0]


class Threshold:
    """Jaccard of at least ``num`` in ``den``, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differing(self, smaller: int) -> int:
        """Most shingles in which two linked sets differ, given the size of the smaller."""
        return (self.den - self.num) * smaller // self.num

    def sizes_fit(self, a, b):  # noqa: ANN001, ANN201
        return (self.den * np.minimum(a, b)) >= (self.num * np.maximum(a, b))

    def spoilt_fits(self, spoilt, smaller):  # noqa: ANN001, ANN201
        """Whether so many groups can be spoilt by the shingles in which two linked sets differ."""
        return self.num * spoilt <= (self.den - self.num) * smaller

    def overlap_fits(self, overlap, a, b):  # noqa: ANN001, ANN201
        return self.den * overlap >= self.num * (a + b - overlap)


def _grouped(u: np.ndarray, limit: Threshold) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """A sorted set by groups: scheme, most shingles that differ there, number of groups, group of each shingle, starts of groups.

    Class k holds sizes from 2**k to 2**(k+1) - 1 and has more groups than linked sets
    can differ in. A set is grouped as its class is, and as the class below if a link can reach there.
    """
    n = len(u)
    k = n.bit_length() - 1
    for scheme in (k, k - 1):
        most = limit.differing((2 << scheme) - 1) if scheme >= 0 else 0
        if most == 0 or (scheme < k and limit.num * n > limit.den * ((1 << k) - 1)):
            continue
        groups = 11 * most // 10 + 2
        group = ((u >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
        yield scheme, most, groups, group, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def held_groups(u: np.ndarray, limit: Threshold) -> tuple[int, int]:
    """How many groups of its class, and of the class below, hold shingles of a sorted set."""
    held = {scheme: len(starts) for scheme, _, _, _, starts in _grouped(u, limit)}
    k = len(u).bit_length() - 1
    return held.get(k, 0), held.get(k - 1, 0)


def leaf_keys(u: np.ndarray, limit: Threshold) -> np.ndarray:
    """Leaves of a sorted set: one per group; the last bit is that of the class.

    Should so many groups be empty that an agreeing group might be an
    empty one, the empty groups are leaves as well, so no link is lost.
    """
    n, found = len(u), []
    for scheme, most, groups, group, starts in _grouped(u, limit):
        content = np.add.reduceat(mix(u + GOLDEN), starts)
        held = group[starts]
        if groups - len(held) + min(most, limit.differing(n)) >= groups:
            missing = np.setdiff1d(np.arange(groups, dtype=np.uint64), held)
            held, content = np.concatenate([held, missing]), np.concatenate([content, np.zeros(len(missing), np.uint64)])
        found.append((mix(content ^ mix(held * GOLDEN + np.uint64(scheme + 1))) & ~np.uint64(1)) | np.uint64(scheme & 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def count_vector(u: np.ndarray) -> bytes:
    """Shingles per coordinate, in the smallest numbers that hold them."""
    counts = np.bincount((u & np.uint64(COORDINATES - 1)).astype(np.int64), minlength=COORDINATES)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def points_of(raw: list[bytes]) -> np.ndarray:
    """Count vectors as rows."""
    if all(len(r) == COORDINATES for r in raw):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, COORDINATES).astype(np.int32)
    return np.array([np.frombuffer(r, np.uint8 if len(r) == COORDINATES else np.uint32) for r in raw], np.int32)


def _print(u: np.ndarray) -> int:
    """Hash of a set."""
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)


def described_sets(df: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """Per row: id, n, fp (hash of the set, null if empty), and at its first sight in a task the count vector and the groups held (own, below)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text", 1 << 20):
            sizes, prints, vectors, held = [], [], [], []
            for u in shingle_sets(*text_buffers(part.column("text")), n):
                fp = _print(u) if len(u) else None
                known = fp is None or fp in seen
                sizes.append(len(u))
                prints.append(fp)
                vectors.append(None if known else count_vector(u))
                held.append((None, None) if known else held_groups(u, limit))
                seen.add(fp)
            if len(seen) > 500_000:
                seen.clear()
            own, below = (pa.array(x, pa.int64()) for x in zip(*held))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(vectors, pa.binary()), own, below], ["id", "n", "fp", "vec", "own", "below"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n long, fp long, vec binary, own long, below long")


def leaf_rows(df: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """(key, fp): the leaves of every set, at its first sight in a task.

    Texts are read a second time for them, as the keys are as large as the texts and would
    have to be stored between the two uses.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "text", 1 << 20):
            keys, prints, counts = [], [], []
            for u in shingle_sets(*text_buffers(part.column("text")), n):
                fp = _print(u) if len(u) else None
                if fp is None or fp in seen:
                    continue
                seen.add(fp)
                keys.append(leaf_keys(u, limit).view(np.int64))
                prints.append(fp)
                counts.append(len(keys[-1]))
            if len(seen) > 500_000:
                seen.clear()
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(prints, np.int64), counts))], ["key", "fp"])

    return df.select("text").mapInArrow(run, "key long, fp long")


def _leaf_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp) sorted: pairs with the leaf's first set (kind 0), other pairs of its first sets (1), members of large leaves (2).

    Of pairs the key is the last bit of the leaf's, which tells its class.
    Keeps the last few rows of the leaf being read, whatever its size.
    """
    keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
    done, hub = 0, 0  # place in its leaf of the first row kept; the leaf's first set
    for batch in batches:
        fresh = len(keys)
        k = np.concatenate([keys, batch.column("key").to_numpy()])
        f = np.concatenate([prints, batch.column("fp").to_numpy()])
        keep = np.concatenate([[True], (k[1:] != k[:-1]) | (f[1:] != f[:-1])])
        keep[:fresh] = True
        k, f = k[keep], f[keep]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        place = np.arange(len(k)) - start
        first = f[start]
        if fresh:
            own = start == 0
            place[own] += done
            first[own] = hub
        own = np.arange(len(k)) >= fresh
        star = own & (place >= 1)
        found = [(np.zeros(star.sum(), np.int8), f[star], first[star], k[star] & 1)]
        for lag in range(1, SMALL_LEAF - 1):
            at = np.flatnonzero(own & (place < SMALL_LEAF) & (place > lag))
            if len(at):
                found.append((np.ones(len(at), np.int8), f[at], f[at - lag], k[at] & 1))
        for lag in range(SMALL_LEAF + 1):
            at = np.flatnonzero(own & (place == SMALL_LEAF)) if lag else np.flatnonzero(own & (place >= SMALL_LEAF))
            found.append((np.full(len(at), 2, np.int8), f[at - lag], np.zeros(len(at), np.int64), k[at]))
        kind, a, b, key = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, a, b, key)], ["kind", "a", "b", "key"])
        tail = max(start[-1], len(k) - SMALL_LEAF)
        done, hub = int(place[tail]), int(first[-1])
        keys, prints = k[tail:], f[tail:]


def _bounded(limit: Threshold):  # noqa: ANN202
    """Keep the pairs whose sizes and summed coordinate minima allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            va, vb = (points_of(batch.column(c).to_pylist()) for c in ("va", "vb"))
            ok = limit.sizes_fit(na, nb) & limit.overlap_fits(np.minimum(va, vb).sum(1, dtype=np.int64), na, nb)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


class BoxTree:
    """Points sorted by size and packed into boxes; a query skips boxes whose upper corner bounds the overlap too low."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray, box: int = 16):
        self.order = np.lexsort((points[:, 0], sizes))
        self.sizes, self.points, self.box = sizes[self.order], points[self.order], box
        starts = np.arange(0, len(sizes), box)
        self.high = np.maximum.reduceat(self.points, starts)
        self.low_size = self.sizes[starts]

    def search(self, size: int, point: np.ndarray, limit: Threshold) -> np.ndarray:
        boxes = np.flatnonzero(limit.overlap_fits(np.minimum(self.high, point).sum(1, dtype=np.int64), size, self.low_size))
        at = (boxes[:, None] * self.box + np.arange(self.box)).ravel()
        at = at[at < len(self.sizes)]
        fits = limit.sizes_fit(size, self.sizes[at]) & limit.overlap_fits(np.minimum(self.points[at], point).sum(1, dtype=np.int64), size, self.sizes[at])
        return self.order[at[fits]]


def _block_pairs(limit: Threshold):  # noqa: ANN202
    """Pairs of a block of left members with a block of all members of one leaf, in different components and within the bounds.

    Two left members meet in both directions, of which one counts. A pair that also
    shares a leaf of a smaller key is left to that leaf; the members name their smallest.
    """

    def read(cell: pa.StructScalar) -> tuple:
        v = cell.values
        return (*(v.field(x).to_numpy() for x in ("fp", "root", "n")), v.field("minor").to_numpy(zero_copy_only=False), points_of(v.field("vec").to_pylist()), [set(k) for k in v.field("least").to_pylist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, left, right in zip(batch.column("key").to_pylist(), batch.column("left"), batch.column("right")):
                (fa, ra, na, _, va, ka), (fb, rb, nb, mb, vb, kb) = read(left), read(right)
                tree = BoxTree(nb, vb)
                for i in range(len(fa)):
                    hits = tree.search(int(na[i]), va[i], limit)
                    hits = hits[(rb[hits] != ra[i]) & (~mb[hits] | (fb[hits] > fa[i]))]
                    found += [(int(fa[i]), int(fb[j])) for j in hits if not any(k < key for k in ka[i] & kb[j])]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sets_of(df: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            sets = list(shingle_sets(*text_buffers(part.column("text")), n))
            prints = [_print(u) if len(u) else None for u in sets]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())], ["fp", "set"])

    return df.select("text").mapInArrow(run, "fp long, set binary")


def _bounded_pairs(pairs: DataFrame, reps: DataFrame, limit: Threshold) -> DataFrame:
    """Distinct pairs of set hashes that sizes and coordinate minima leave."""
    side = lambda x: reps.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("vec").alias(f"v{x}"))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded(limit), "a long, b long")


def _facts(reps: DataFrame, crowds: DataFrame) -> DataFrame:
    """Per set: fp, n, class, the groups held and the crowded leaves of that class and of the one below."""
    last = F.col("key").bitwiseAND(F.lit(1))
    many = crowds.groupBy(F.col("a").alias("fp")).agg(*[F.count(F.when(last == bit, 1)).alias(f"many{bit}") for bit in (0, 1)])
    of = lambda even: F.coalesce(F.when(even, F.col("many0")).otherwise(F.col("many1")), F.lit(0))
    reps = reps.select("fp", "n", (F.length(F.bin("n")) - 1).alias("class"), "own", "below").join(many, "fp", "left")
    even = F.col("class") % 2 == 0
    return checkpointed(reps.select("fp", "n", "class", "own", "below", of(even).alias("many_own"), of(~even).alias("many_below")))


def _promising(pairs: DataFrame, facts: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs that may link by their sizes and the leaves they share.

    ``even`` and ``odd`` count the leaves shared that are not crowded, by the last bit of
    the key; of crowded ones two sets share no more than each is in. Linked sets share all
    groups that one of them holds but those spoilt by shingles in which they differ.
    """
    side = lambda x: facts.select(*[F.col(c).alias(x if c == "fp" else f"{x}_{c}") for c in facts.columns])
    both = lambda f, c: f(F.col(f"a_{c}"), F.col(f"b_{c}"))
    of = lambda x, c: F.when(F.col(f"{x}_class") == both(F.least, "class"), F.col(f"{x}_{c}own")).otherwise(F.col(f"{x}_{c}below"))
    shared = F.when(both(F.least, "class") % 2 == 0, F.col("even")).otherwise(F.col("odd")) + F.least(of("a", "many_"), of("b", "many_"))
    smaller = both(F.least, "n")
    fits = (limit.den * smaller >= limit.num * both(F.greatest, "n")) & limit.spoilt_fits(F.greatest(of("a", ""), of("b", "")) - shared, smaller)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits).select(*pairs.columns)


def _crowded(crowds: DataFrame, facts: DataFrame, limit: Threshold) -> DataFrame:
    """The (key, a) of crowded leaves that may hold a linked pair which shares no other leaves: the set is in enough crowded ones of the key's class."""
    own = F.col("key").bitwiseAND(F.lit(1)) == F.col("class") % 2
    below = F.least(F.col("n"), F.expr("shiftleft(1L, class)") - 1)  # most shingles of a set of the class below
    fits = F.when(own, limit.spoilt_fits(F.col("own") - F.col("many_own"), F.col("n"))).otherwise(limit.spoilt_fits(F.col("below") - F.col("many_below"), below))
    return checkpointed(compact(crowds.join(facts.withColumnRenamed("fp", "a"), "a").where(fits).select("key", "a")))


def _sets_named(named: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(fp, set) of the sets ``named`` (fp, _id), from the texts of one document each.

    The ids of these documents are sent to all executors only after a check of their number.
    """
    ids = named.select("_id").distinct()
    ids = F.broadcast(ids) if named.count() <= BROADCAST_IDS else ids
    sets = _sets_of(rows.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi"), n)
    return sets.join(named.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, reps: DataFrame, rows: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """Those of the different pairs of set hashes that link, counted on the sets of one document each.

    Texts are read again for the documents named, so no set is stored.
    """
    pairs = checkpointed(compact(pairs))
    named = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = _sets_named(checkpointed(named.join(reps, "fp").select("fp", F.col("id").alias("_id"))), rows, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                ok.append(bool(limit.overlap_fits(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v))))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("sb")), "b")
    return checkpointed(compact(both.mapInArrow(run, "a long, b long")))


def _rooted(x: DataFrame, c: str, roots: DataFrame) -> DataFrame:
    """Add the component of column ``c``."""
    near = roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    return x.join(near, c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    return _rooted(_rooted(pairs, "a", roots), "b", roots).where("ra <> rb").select("a", "b")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links."""
    if not links.head(1):
        return roots
    return checkpointed(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)))


def _moved(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) after further links, by one step: each component takes the label of one that it links with.

    Equal labels are surely joined, but not all that is joined has equal labels.
    """
    to = _rooted(_rooted(links, "a", roots), "b", roots).where("ra <> rb").groupBy("ra").agg(F.min("rb").alias("rb"))
    to = checkpointed(compact(to))
    known = roots.join(to, F.col("root") == F.col("ra"), "left").select("node", F.coalesce("rb", "root").alias("root"))
    return checkpointed(known.unionByName(to.select(F.col("ra").alias("node"), F.col("rb").alias("root"))))


def _mixed(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, a, ra, minor, size, minors): members of crowded leaves with several components, and counts of a leaf's members.

    Minor are those outside the leaf's largest component.
    """
    members = _rooted(crowds, "a", roots)
    # pairs inside the largest need no look
    sizes = members.groupBy("key", "ra").agg(F.count(F.lit(1)).alias("c"))
    counts = [F.sum("c").alias("size"), (F.sum("c") - F.max("c")).alias("minors"), F.count(F.lit(1)).alias("roots")]
    mixed = sizes.groupBy("key").agg(F.max_by("ra", F.struct("c", "ra")).alias("top"), *counts).where("roots > 1").drop("roots")
    return checkpointed(compact(members.join(mixed, "key").withColumn("minor", F.col("ra") != F.col("top")).drop("top")))


def _to_largest(members: DataFrame) -> DataFrame:
    """Pairs of each minor member of a leaf with four members of its largest component."""
    spread = F.xxhash64("a")
    four = F.array(F.min("a"), F.max("a"), F.min_by("a", spread), F.max_by("a", spread))
    return members.where("minor").join(members.where("not minor").groupBy("key").agg(four.alias("b")), "key").select("a", F.explode("b").alias("b"))


def _crossed(members: DataFrame, reps: DataFrame, limit: Threshold) -> DataFrame:
    """All pairs of sets of a leaf that lie in different components, within the bounds.

    Blocks of minor members meet blocks of all members in the cells of a grid, CELL by CELL of
    them in a cell, so a leaf of any size is dealt over tasks and small leaves share them.
    """
    least = members.groupBy("a").agg(F.slice(F.sort_array(F.collect_set("key")), 1, 8).alias("least"))  # at most a leaf per group of the set
    point = reps.select(F.col("fp").alias("a"), "n", "vec").join(least, "a")
    member = F.struct(F.col("a").alias("fp"), F.col("ra").alias("root"), "n", "minor", "vec", "least")

    most = int(np.ceil(np.sqrt(shuffle_parts(reps))))
    extent = lambda of, size: F.least(F.ceil(F.col(of) / (CELL * size)), F.lit(most)).cast("long")

    def blocks(of: DataFrame, name: str, size: int) -> DataFrame:
        placed = dense_slots(of, ["key"], ["a"], "slot", spread=8).join(point, "a")
        placed = placed.groupBy("key", extent("minors", MINORS).alias("rows"), extent("size", MEMBERS).alias("cols"), F.floor(F.col("slot") / size).alias("block"))
        return placed.agg(F.collect_list(member).alias(name))

    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = blocks(members.where("minor"), "left", MINORS).select("key", F.expr("block % rows").alias("r"), every("cols").alias("c"), "left")
    right = blocks(members, "right", MEMBERS).select("key", every("rows").alias("r"), F.expr("block % cols").alias("c"), "right")
    # dealt by number, as a join that Spark splits for skew has thousands of tasks, each of which costs more than its blocks
    left, right = (x.repartition(shuffle_parts(reps), "key", "r", "c") for x in (left, right))
    crossed = left.join(right, ["key", "r", "c"]).mapInArrow(_block_pairs(limit), "a long, b long")
    return crossed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _block_links(limit: Threshold):  # noqa: ANN202
    """Of two blocks of one component: how many rows of the right block each set of the left one links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, b = left.values, right.values
                mine, theirs = ([np.frombuffer(x, np.uint64) for x in side.field("set").to_pylist()] for side in (a, b))
                ids, other, copies = a.field("fp").to_numpy(), b.field("fp").to_numpy(), b.field("copies").to_numpy()
                sizes = np.array([len(x) for x in theirs], np.int64)
                begins = np.cumsum(sizes) - sizes
                names, place = np.unique(np.concatenate(theirs), return_inverse=True)
                counts = np.zeros(len(ids), np.int64)
                for i, own in enumerate(mine):
                    at = np.searchsorted(names, own)
                    at[at == len(names)] = 0
                    held = np.zeros(len(names), np.int64)
                    held[at[names[at] == own]] = 1
                    linked = limit.overlap_fits(np.add.reduceat(held[place], begins), len(own), sizes) & (other != ids[i])
                    counts[i] = copies[linked].sum()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], ["fp", "links"])

    return run


def count_links(members: DataFrame, rows: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """(fp, links): how many rows with another set each set of ``members`` (fp, root, _id, copies) links with.

    Links lie inside components, so each component's sets are compared with each other,
    block by block; pairs are counted, never written.
    """
    blocks = dense_slots(members, ["root"], ["fp"], "slot", spread=8)
    parts = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    blocks = blocks.join(parts, "root").join(_sets_named(members.select("fp", "_id"), rows, n), "fp")
    blocks = blocks.groupBy("root", "parts", F.floor(F.col("slot") / BLOCK).alias("block")).agg(F.collect_list(F.struct("fp", "copies", "set")).alias("sets"))
    pairs = paired_blocks(checkpointed(blocks), "root", "parts", "block", "sets")
    return pairs.mapInArrow(_block_links(limit), "fp long, links long").groupBy("fp").agg(F.sum("links").alias("links"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, limit: Threshold | None = None, links: bool = True) -> DataFrame:
    """Per row of ``df``: its id, n_shingles, component_id, the smallest id reachable by links, and n_links, the other rows it links with.

    Words are runs without ASCII white space, A-Z lowered; a text of fewer than n words
    is one shingle, one without words (or null) is empty and its own component. Rows
    with equal sets are one point, so copies are never paired. First every set is paired
    with one first set of its leaves; pairs whose sets are then still in different
    components are checked too, all of them. Links are counted inside the components
    that come out, copies included; without ``links`` they are not counted. Null ids never
    name a component unless it has no other. Extra columns are left out. ``limit`` is one half or more.
    """
    limit = limit or Threshold(80, 100)
    if 2 * limit.num < limit.den:
        raise ValueError("sets less than half alike may share no leaf")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = checkpointed(described_sets(rows, n, limit))
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("vec", "own", "below")]
    reps = checkpointed(sets.where("fp is not null").groupBy("fp").agg(F.min("id").alias("id"), F.first("n").alias("n"), *first, F.count(F.lit(1)).alias("copies")))
    leaves = leaf_rows(rows, n, limit).repartition(shuffle_parts(df), "key").sortWithinPartitions("key", "fp")
    found = leaves.mapInArrow(_leaf_pairs, "kind tinyint, a long, b long, key long")
    found = checkpointed(found.groupBy("kind", "a", "b", "key").agg(F.count(F.lit(1)).alias("leaves")))
    crowds = found.where("kind = 2").select("key", "a")
    facts = _facts(reps, crowds)
    counts = [F.sum(F.when(F.expr(which), F.col("leaves")).otherwise(0)).alias(name) for name, which in (("even", "key = 0"), ("odd", "key = 1"), ("star", "kind = 0"))]
    pairs = checkpointed(_promising(found.where("kind < 2").groupBy("a", "b").agg(*counts), facts, limit).select("a", "b", "star"))
    # at first each set with the one of its leaves' first sets that it shares most leaves with
    stars = pairs.where("star > 0").groupBy("a").agg(F.max_by("b", F.struct("star", "b")).alias("b"))
    stars = _verified(_bounded_pairs(stars, reps, limit), reps, rows, n, limit)
    # labels from one step of these links: equal labels are surely joined
    others = _apart(pairs.select("a", "b"), stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
    others = _verified(_bounded_pairs(others, reps, limit), reps, rows, n, limit)
    roots = checkpointed(components(stars.unionByName(others)))
    # linked pairs that are not joined yet share crowded leaves alone, as all others were checked
    crowds = _crowded(crowds, facts, limit)
    alone = lambda pairs: _promising(pairs.distinct().select("a", "b", F.lit(0).alias("even"), F.lit(0).alias("odd")), facts, limit)
    members = _mixed(crowds, roots)
    if members.head(1):
        # with a few of the largest component first, so that what is left to compare in full is little
        near = _verified(_bounded_pairs(alone(_to_largest(members)), reps, limit), reps, rows, n, limit)
        members = _mixed(crowds, _moved(roots, near))
        far = _verified(alone(_crossed(members, reps, limit)).select("a", "b"), reps, rows, n, limit)
        roots = _joined(roots, near.unionByName(far))
    final = roots.withColumnRenamed("node", "fp")
    final = final.unionByName(final.select(F.col("root").alias("fp"), "root").distinct())  # a root is no node there
    named = reps.select("fp", "id", "copies").join(final, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    kept = [F.col("fp").alias("_fp"), "component_id"]
    if links:
        members = checkpointed(final.join(reps, "fp").select("fp", "root", F.col("id").alias("_id"), "copies"))
        named = named.join(count_links(members, rows, n, limit), "fp", "left")
        kept.append((F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = named.join(smallest, "root").select(*kept)
    out = sets.select("id", "n", "fp").join(named, F.col("fp") == F.col("_fp"), "left")
    own = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")]
    return out.select(*own, *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []))


def keep_one(df: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """One row of each group stays, with all its columns: that of the smallest doc_id, null last, then of the smallest hash of its text.

    Rows are told apart by their number, so rows that share an id but not a text are
    judged each on its own; ``df`` must give the same rows in the same partitions whenever it is read, as tables do.
    Documents without words stay, as each is a group of its own, but of equal ids and texts one stays.
    """
    row, digest, word, bits = fresh(df, "row", "digest", "word", "bits")
    rows = df.withColumn(row, F.monotonically_increasing_id())
    found = jaccard_components(rows, id_col=row, links=False, **options)
    named = rows.select(row, "doc_id", F.md5("text").alias(digest))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(digest).alias("digest"), F.col(row).alias("row"))
    first = found.join(named, row).groupBy("component_id").agg(F.min(order).alias("m"))
    chosen = first.groupBy("m.id", "m.digest").agg(F.min("m.row").alias(row)).select(row)
    # one bit a row, 64 to a number, so that the texts stay where they are
    bit = F.expr(f"cast({row} % 64 as int)")
    marks = chosen.groupBy(F.expr(f"{row} div 64").alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(bits))
    marks = checkpointed(compact(marks))
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
    return rows.withColumn(word, F.expr(f"{row} div 64")).join(marks, word).where(F.getbit(bits, bit) == 1).select(*df.columns)
