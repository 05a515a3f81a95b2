"""Removal of repeated passages by suffix arrays.

Every window of the given length has one anchor: the gram with the smallest hash in
it. Equal windows have equal anchors, so the stretches of window starts that share an
anchor meet in one group wherever they lie. Stretches with equal bytes are repeats at
once; the different ones of an anchor go into a suffix array built by two-stage
sorting: the suffixes smaller than their successors are sorted directly, the others are
induced from them by scanning the buckets, and the adjacent common prefixes of the array
show the windows that occur again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import checkpointed, fresh, shuffle_parts, slices, text_buffers

GRAM = 64
CHUNK = 1 << 19
#: Different stretches of an anchor that are compared as they are; the stretches of a crowd are first cut into pieces.
CROWD = 512
#: Window starts of a piece; pieces of a crowd meet only where the bytes that all their windows share are equal.
PIECE = 16
#: Such pieces that one suffix array holds; more are counted window by window.
PIECES = 1024
#: Bytes that one suffix array holds.
ARRAY_BYTES = 1 << 18
#: Up to this many text hashes (8 bytes each) are sent to every executor, to pick the texts that a join needs; beyond it the join shuffles all texts.
BROADCAST_KEYS = 2_000_000

#: Bits of a gram's hash that hold its place instead while the smallest one is looked for.
LOW = np.uint64(2 * CHUNK - 1)

_BYTE = np.random.default_rng(400).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.random.default_rng(401).integers(0, 2**63, (12, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of every substring of ``length`` bytes, from halves that may overlap."""
    h, size, step = _BYTE[data], 1, 0
    while size < length:
        move = min(size, length - size)
        h = _mix(h[: len(h) - move] * _ODD[step, 0] + h[move:] * _ODD[step, 1])
        size, step = size + move, step + 1
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> Iterator[list[tuple]]:
    """Per text: (anchor, content hash, first start, number of starts, bytes, loops), covering every window of the least length once.

    A stretch reaches from its first start to the end of the longest window at its last
    one, or of the text. Where the anchor occurs again and again, as in a text of one
    letter, a stretch goes on until the place it began with has left the windows; only
    such a stretch, which loops, can hold a window twice.
    """
    short, long = lengths[0], lengths[-1]
    view = memoryview(np.ascontiguousarray(data))

    def part(begin: int, bounds: np.ndarray, ends: np.ndarray) -> list[list[tuple]]:
        """Of the texts between ``bounds``, counted from ``begin``; ``ends`` are where their bytes end."""
        own = data[begin : begin + bounds[-1]]
        out: list[list[tuple]] = [[] for _ in bounds[1:]]
        if len(own) < short:
            return out
        grams = gram_hashes(own, GRAM)
        places, width = np.arange(len(grams), dtype=np.uint64), short - GRAM + 1
        at = (sliding_min((grams & ~LOW) | places, width) & LOW).astype(np.int64)
        least = grams[at]
        valid = np.zeros(len(at), dtype=bool)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            valid[a : max(a, b - short + 1)] = True
        # a new stretch begins with another gram, or where the gram found first has left the windows
        new = valid.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
        moved = np.flatnonzero(valid[1:] & ~new[1:] & (at[1:] != at[:-1])) + 1
        if len(moved):
            # the gram occurs again: its last place in the first window stands for all windows that hold it
            behind = (LOW - (sliding_min((grams & ~LOW) | (LOW - places), width) & LOW)).astype(np.int64)
            behind = np.where(grams[behind] == least, behind, at)
            heads = np.flatnonzero(new)
            stop = np.append(np.flatnonzero(new | ~valid), len(valid))
            for s in np.unique(heads[np.searchsorted(heads, moved, side="right") - 1]).tolist():
                end, s = int(stop[np.searchsorted(stop, s, side="right")]), int(behind[s]) + 1
                while s < end:
                    new[s] = True
                    s = int(behind[s]) + 1
        end = valid.copy()
        end[:-1] &= new[1:] | ~valid[1:]
        starts, lasts = np.flatnonzero(new), np.flatnonzero(end)
        anchors = least[starts].view(np.int64).tolist()
        rows = np.searchsorted(bounds, starts, side="right") - 1
        stops = np.minimum(lasts + long + begin, ends[rows])
        loops = (at[starts] != at[lasts]).tolist()
        for anchor, s, e, stop, row, base, loop in zip(anchors, starts.tolist(), lasts.tolist(), stops.tolist(), rows.tolist(), bounds[rows].tolist(), loops):
            salt = (e - s + 1).to_bytes(4, "little")  # equal bytes at the end of a text may hold more starts
            content = int.from_bytes(hashlib.blake2b(view[s + begin : stop], digest_size=8, salt=salt).digest(), "little", signed=True)
            out[row].append((anchor, content, s - base, e - s + 1, stop - s - begin, loop))
        return out

    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        first, last = int(offsets[i]), int(offsets[j])
        if last - first <= CHUNK:
            yield from part(first, offsets[i : j + 1] - first, offsets[i + 1 : j + 1])
        else:  # one long text: in parts whose windows do not overlap
            found = []
            for a in range(first, last - short + 1, CHUNK - short + 1):
                own = part(a, np.array([0, min(CHUNK, last - a)]), np.array([last]))[0]
                found += [(x, c, s + a - first, *rest) for x, c, s, *rest in own]
            yield found
        i = j


def pieces_of(stretch: bytes, n: int, lengths: tuple[int, ...]) -> Iterator[tuple[int, int, int, bytes]]:
    """(first start, number of starts, hash of the bytes that the piece's windows share, bytes) of a stretch with ``n`` starts.

    A start is numbered from the furthest one that could hold the first place of the
    anchor in its window, so that equal windows lie in pieces of one number.
    """
    short, long = lengths[0], lengths[-1]
    grams = gram_hashes(np.frombuffer(stretch[: n - 1 + short], np.uint8), GRAM) & ~LOW
    places = np.flatnonzero(grams == grams.min())
    first = places[np.searchsorted(places, np.arange(n))]
    lead = short - GRAM - first  # of the stretch's first start; each later start is one further
    number = (lead + np.arange(n)) // PIECE
    cuts = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (number[1:] != number[:-1]))).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], n]):
        q, d = int(number[lo]), int(lead[lo])
        core = hashlib.blake2b(stretch[(q + 1) * PIECE - 1 - d : q * PIECE + short - d], digest_size=8, salt=str(q).encode()).digest()
        yield lo, hi - lo, int.from_bytes(core, "little", signed=True), stretch[lo : hi - 1 + long]


#: Ends every stretch in a suffix array; no UTF-8 text holds this byte.
END = b"\xff"


def eight_bytes(data: np.ndarray, past: int) -> np.ndarray:
    """The eight bytes from each place on as one number that compares like them, for ``past`` places past the end too."""
    out = np.concatenate([data, np.zeros(past + 8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        out = (out[:-width] << np.uint64(8 * width)) | out[width:]
    return out


def two_stage_suffixes(text: bytes, depth: int | None = None, chosen: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of ``text`` in the order of their first ``depth`` bytes (of all bytes, without it).

    Only suffixes smaller than their successors are sorted by comparing bytes. The others
    follow in one scan over the buckets of the first byte: the suffix that starts before a
    sorted one, and is larger than it, goes to the next free place of its own bucket.
    With ``chosen``, a flag for each place, the array has only the chosen suffixes and
    those after them that they are induced from.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    # smaller than its successor: by the first later byte that differs
    change = np.flatnonzero(data[1:] != data[:-1])
    rises = np.zeros(n, dtype=bool)
    if len(change):
        up = np.repeat(data[change + 1] > data[change], np.diff(change, prepend=-1))
        rises[: len(up)] = up
    if chosen is None:
        chosen = np.ones(n, dtype=bool)
    else:
        last = np.flatnonzero(chosen & ~rises & ~np.append(chosen[1:], False))
        ups = np.append(np.flatnonzero(rises), n - 1)
        step = np.bincount(last, minlength=n + 1) - np.bincount(ups[np.searchsorted(ups, last)] + 1, minlength=n + 1)
        chosen = chosen | (np.cumsum(step)[:n] > 0)
    letters, width = text.decode("latin-1"), depth or n  # a letter a byte, in the same order
    wanted, packed = np.flatnonzero(rises & chosen), eight_bytes(data, 16)
    wanted = wanted[np.lexsort((packed[wanted + 8], packed[wanted]))]  # a sort of what is nearly in order compares less
    direct = np.array(sorted(wanted.tolist(), key=lambda i: letters[i : i + width]), np.int64)
    sizes = np.bincount(data[chosen], minlength=256)
    starts = np.cumsum(sizes) - sizes
    falls = np.bincount(data[chosen & ~rises], minlength=256)
    firsts = data[direct]
    place = np.arange(len(direct)) - np.searchsorted(firsts, firsts)
    array = np.full(sizes.sum(), -1, np.int64)
    array[starts[firsts] + falls[firsts] + place] = direct  # those smaller than their successor end their bucket
    # for each suffix the byte before it if a falling suffix to be placed starts there, else -1
    before = np.full(n, -1, np.int64)
    before[1:] = np.where(chosen[:-1] & ~rises[:-1], data[:-1].astype(np.int64), -1)
    order, symbol, heads = array.tolist(), before.tolist(), starts.tolist()
    if chosen[-1]:
        order[heads[text[-1]]] = n - 1
        heads[text[-1]] += 1
    for i in range(len(order)):
        j = order[i]
        c = symbol[j]
        if c >= 0:
            order[heads[c]] = j - 1
            heads[c] += 1
    return np.array(order, np.int64)


def adjacent_prefixes(text: bytes, array: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix length of each suffix in the array with the one before it there, counted up to ``depth`` bytes."""
    n = len(text)
    packed = eight_bytes(np.frombuffer(text, np.uint8), depth)
    out = np.zeros(len(array), np.int64)
    open_, a, b = np.arange(1, len(array)), array[1:], array[:-1]  # places in the array whose prefix is equal so far
    for done in range(0, depth, 8):
        differ = packed[a] ^ packed[b]
        same = differ == 0
        if not same.all():
            high = differ[~same]
            bits = np.frexp((high & ~(high >> np.uint64(1))).astype(np.float64))[1]  # without the second bit none is rounded up
            out[open_[~same]] = done + (64 - bits) // 8
            open_, a, b = open_[same], a[same], b[same]
        if not len(open_):
            break
        out[open_] = done + 8
        a, b = a + 8, b + 8
    out[1:] = np.minimum(out[1:], n - np.maximum(array[1:], array[:-1]))  # no suffix goes past the end
    return np.minimum(out, depth)


def repeated_starts(stretch_bytes: list[bytes], starts: list[int], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each length and stretch, whether the window of that length at each of its starts also begins at a start of any stretch.

    Starts with fewer bytes before the stretch's end have no such window.
    """
    text = END.join(stretch_bytes) + END
    bases = np.concatenate([[0], np.cumsum([len(b) + 1 for b in stretch_bytes])]).astype(np.int64).tolist()
    valid = np.zeros(len(text), dtype=bool)
    left = np.zeros(len(text), np.int64)
    for base, n, own in zip(bases, starts, stretch_bytes):
        valid[base : base + n] = True
        left[base : base + n] = len(own) - np.arange(n)
    array = two_stage_suffixes(text, lengths[-1], valid)
    array = array[valid[array]]
    prefix = adjacent_prefixes(text, array, lengths[-1])
    out = []
    for length in lengths:
        # suffixes between two breaks of the prefixes share a window
        group, whole = np.cumsum(prefix < length), left[array] >= length
        again = np.zeros(len(text), dtype=bool)
        again[array] = (np.bincount(group, weights=whole) > 1)[group] & whole
        out.append([again[b : b + n] for b, n in zip(bases, starts)])
    return out


def _runs(flags: np.ndarray, window: int, base: int) -> list[dict[str, int]]:
    """Byte ranges covered by the windows at flagged starts, the first of which is ``base``."""
    at = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"a": int(a) + base, "b": int(b) - 1 + window + base, "w": window} for a, b in zip(at[::2], at[1::2])]


#: Ranges from a to b that windows of w bytes cover.
RANGES = "array<struct<a:long,b:long,w:int>>"
_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int32())]))


def _chosen(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among ``keys``: all those that are, and others where there are too many keys to send."""
    if keys.count() > BROADCAST_KEYS:
        return rows
    return rows.join(F.broadcast(keys.select(F.xxhash64("key").alias("_h"))), F.xxhash64("key") == F.col("_h"), "left_semi")


def repeated_ranges(rows: DataFrame, lengths: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(key, ranges) of texts with repeats, and (key, copies) of texts that occur again; ``rows`` has key (a digest of the text) and text.

    ``lengths`` rise; windows of all of them are found in one go, as equal windows start
    with equal windows of the least length and so have the same anchor.
    """
    short, long = lengths[0], lengths[-1]
    rows = rows.where(F.octet_length("text") >= short)
    fields = {"anchor": pa.int64(), "content": pa.int64(), "start": pa.int32(), "n": pa.int32(), "size": pa.int32(), "loops": pa.bool_()}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        kind = pa.list_(pa.struct(list(fields.items())))
        for part in slices(batches, "text", CHUNK):
            found = []
            keys = part.column("key").to_pylist()
            for key, own in zip(keys, stretches(*text_buffers(part.column("text")), lengths)):
                found.append(None if key in seen else [dict(zip(fields, s)) for s in own])
                seen.add(key)
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, kind)], ["key", "found"])

    indexed = checkpointed(rows.mapInArrow(index, "key binary, found array<struct<anchor:long,content:long,start:int,n:int,size:int,loops:boolean>>"))
    copies = indexed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    all_stretches = indexed.select("key", F.inline("found"))
    # counts are checkpointed before they are joined, so that Spark can split an anchor that very many stretches share
    shared = checkpointed(all_stretches.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.bool_or("loops").alias("loops")).where("c > 1 or loops").select("anchor"))
    # texts seen by two tasks give equal stretches twice, which is right: they are copies
    shared = checkpointed(all_stretches.join(shared, "anchor", "left_semi"))
    distinct = shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "start", "n", "size")).alias("at"), F.bool_or("loops").alias("loops"))
    distinct = checkpointed(distinct)
    crowd = checkpointed(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.bool_or("loops").alias("loops")).where("m > 1 or loops").drop("loops"))
    wanted = distinct.join(crowd, "anchor").select("anchor", "content", (F.col("m") > CROWD).alias("crowded"), "at.*")
    wanted = checkpointed(wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "content", "crowded", "start", "n", "size")).alias("wanted")))
    # one copy of each text that is wanted
    texts = _chosen(rows, wanted).groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "content", "base", "n", "core", "bytes"]
        for part in slices(batches, "text", CHUNK):
            out = []
            for text, own in zip(*(part.column(c).to_pylist() for c in ("text", "wanted"))):
                raw = text.encode()
                for s in own:
                    b = raw[s["start"] : s["start"] + s["size"]]
                    if not s["crowded"]:
                        out.append((s["anchor"], s["content"], 0, s["n"], None, b))
                        continue
                    out += [(s["anchor"], s["content"], *piece) for piece in pieces_of(b, s["n"], lengths)]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (*(pa.int64(),) * 5, pa.binary()))], names)

    pieces = checkpointed(texts.mapInArrow(cut, "anchor long, content long, base long, n long, core long, bytes binary"))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(own: list[tuple]) -> pa.RecordBatch:
            flags = repeated_starts([x[5] for x in own], [x[3] for x in own], lengths)
            kept = [(x[0], x[1], r) for length, each in zip(lengths, flags) for x, f in zip(own, each) if (r := _runs(f, length, x[2]))]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), _RANGES))], ["anchor", "content", "ranges"])

        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "base", "n", "core", "bytes"))):
                if size > ARRAY_BYTES and (x[0], x[4]) != (waiting[-1][0], waiting[-1][4]):
                    yield settle(waiting)
                    waiting, size = [], 0
                waiting.append(x)
                size += len(x[5])
        if waiting:
            yield settle(waiting)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in range(5)]
            for anchor, content, base, n, raw in zip(*(batch.column(x).to_pylist() for x in ("anchor", "content", "base", "n", "bytes"))):
                for length in lengths:
                    h = gram_hashes(np.frombuffer(raw, np.uint8), length)[:n] if len(raw) >= length else np.zeros(0, np.uint64)
                    for column, value in zip(found, (np.full(len(h), anchor), np.full(len(h), content), base + np.arange(len(h)), np.full(len(h), length), h.view(np.int64))):
                        column.append(value.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [np.zeros(0, np.int64)])) for c in found], ["anchor", "content", "i", "w", "window"])

    crowd = pieces.where("core is not null")
    sizes = crowd.groupBy("anchor", "core").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    crowd = crowd.join(sizes, ["anchor", "core"]).select(*pieces.columns, "c")
    few = pieces.where("core is null").unionByName(crowd.where(F.col("c") <= PIECES).drop("c"))
    few = few.repartition(shuffle_parts(rows), "anchor", "core").sortWithinPartitions("anchor", "core", "content", "base").mapInArrow(arrays, f"anchor long, content long, ranges {RANGES}")
    each = crowd.where(F.col("c") > PIECES).drop("c").mapInArrow(windows, "anchor long, content long, i long, w long, window long").distinct()
    again = each.groupBy("anchor", "w", "window").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor", "w", "window")
    many = each.join(again, ["anchor", "w", "window"], "left_semi").groupBy("anchor", "content")
    many = many.agg(F.collect_list(F.struct(F.col("i").alias("a"), (F.col("i") + F.col("w")).alias("b"), F.col("w").cast("int").alias("w"))).alias("ranges"))
    range_ = lambda b, w: F.struct(F.lit(0).cast("long").alias("a"), b.cast("long").alias("b"), F.lit(w).alias("w"))
    # of stretches that occur again as a whole, all windows do
    all_of = F.array(*[F.when(F.col("at.size") >= w, range_(F.least(F.col("at.n") - 1 + w, F.col("at.size")), w)) for w in lengths])
    whole = distinct.where("c > 1").select("anchor", "content", F.array_compact(all_of).alias("ranges"))
    known = checkpointed(whole.unionByName(few).unionByName(many))
    placed = shared.join(known, ["anchor", "content"]).select("key", F.transform("ranges", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b"), r["w"].alias("w"))).alias("r"))
    ranges = placed.groupBy("key").agg(F.flatten(F.collect_set("r")).alias("ranges"))
    return ranges, copies.where("copies > 1")


def _removed(text: str, copied: bool, ranges: list[dict[str, int]] | None, window: int) -> tuple[bytes, list[tuple[int, int]], bytes]:
    """The bytes of a text, its maximal removed runs, and the bytes left."""
    raw = text.encode()
    if copied and len(raw) >= window:
        return raw, [(0, len(raw))], b""
    merged: list[tuple[int, int]] = []
    for r in sorted((r for r in ranges or [] if r["w"] == window), key=lambda r: r["a"]):
        if merged and r["a"] <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], r["b"]))
        else:
            merged.append((r["a"], r["b"]))
    kept, at = [], 0
    for a, b in merged:
        kept.append(raw[at:a])
        at = b
    return raw, merged, b"".join([*kept, raw[at:]])


def with_repeats(df: DataFrame, lengths: tuple[int, ...], text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``df`` with three more columns, and their names: the text (never null), whether it occurs again as a whole, its repeated ranges."""
    text, key, again, ranges, lost = fresh(df, "whole", "key", "again", "ranges", "lost")
    rows = df.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(key, F.unhex(F.md5(F.col(text))))
    found, copies = repeated_ranges(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), lengths)
    losses = found.join(copies, "key", "full").select(F.col("key").alias(lost), F.col("copies").isNotNull().alias(again), F.when(F.col("copies").isNull(), F.col("ranges")).alias(ranges))
    losses = checkpointed(losses)
    on = F.col(key) == F.col(lost)
    if losses.count() > BROADCAST_KEYS:
        return rows.join(losses, on, "left").drop(key, lost), [text, again, ranges]
    # texts that lose nothing stay where they are
    near, (h,) = F.xxhash64(key), fresh(rows, "h")
    keys = F.broadcast(losses.select(F.xxhash64(lost).alias(h)))
    some = rows.join(keys, near == F.col(h), "left_semi").join(losses, on, "left").drop(lost)
    others = rows.join(keys, near == F.col(h), "left_anti").withColumns({again: F.lit(None).cast("boolean"), ranges: F.lit(None).cast(RANGES)})
    return some.unionByName(others).drop(key), [text, again, ranges]


def dedup_report(df: DataFrame, window: int = 400, passage: int = 240) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passage_bytes of every row.

    Removed is each byte covered by a string of ``window`` bytes that also starts
    elsewhere, in the same text or another; of rows that repeat, each is elsewhere to the
    other. n_passage_bytes counts, with nothing removed for it, the bytes that strings of
    ``passage`` bytes (at most ``window``) cover in the same way: passages of some fifty
    words are shorter than the default window. Null texts are empty; texts shorter than
    the window lose nothing. Equal texts are found by a digest of 128 bits.
    """
    lengths = (passage, window) if passage < window else (window,)
    found, names = with_repeats(df.select("doc_id", "text"), lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, names[0]):
            rows = list(zip(*(part.column(c).to_pylist() for c in names)))
            cut = [_removed(*x, window) for x in rows]
            passages = [len(raw) - len(kept) for raw, _, kept in (_removed(*x, lengths[0]) if x[1] or x[2] else (b"", [], b"") for x in rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(raw) for raw, _, _ in cut], pa.int64()),
                    pa.array([len(raw) - len(kept) for raw, _, kept in cut], pa.int64()),
                    pa.array([len(runs) for _, runs, _ in cut], pa.int64()),
                    pa.array([hashlib.sha256(kept).hexdigest() for _, _, kept in cut], pa.string()),
                    pa.array(passages, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"],
            )

    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long"
    return found.select("doc_id", *names).mapInArrow(run, schema)


def remove_repeats(df: DataFrame, window: int = 400, text_col: str = "text") -> DataFrame:
    """``df`` with its repeated passages cut out of the text; code points cut in two are dropped whole.

    All rows and columns stay, whatever the columns are called; a null text stays null.
    """
    columns = df.columns
    found, names = with_repeats(df, (window,), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, names[0]):
            texts = [
                None if old is None else old if not (c or r) else _removed(t, c, r, window)[2].decode(errors="ignore")
                for old, t, c, r in zip(*(part.column(c).to_pylist() for c in (text_col, *names)))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else part.column(c) for c in columns], columns)

    return found.mapInArrow(run, T.StructType(df.schema.fields))
