"""Manifest, whitening and mixing against brute force, on tables with nulls, ties, repeated rows, empty and long texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetloom.llm import merkle, mixing, whitening

rng = random.Random(3)
DOC = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, own string"
TEXTS = ["", None, "Aé ß Z", "x" * 60_000, "B a\tC\nd", "same text"]


def rows_of(n, sources):
    out = []
    for k in range(n):
        text = rng.choice(TEXTS) if rng.random() < 0.2 else " ".join(f"W{rng.randrange(90)}" for _ in range(rng.randrange(60)))
        out.append((k * 3, text, rng.choice(["en", None]), rng.choice(sources), None if k % 11 == 0 else k, "t", k, "o"))
    return out


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(*[enc(v) for v in (row[0], row[3], row[2], row[4], text)])


def climb_by_hand(nodes):
    """Root, and for each node the flanks met on the way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            start = at[k] // 16 * 16
            path.append(("".join(nodes[start : at[k]]), "".join(nodes[at[k] + 1 : start + 16])))
            at[k] //= 16
        nodes = [digest(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def manifest_by_hand(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[3], []).append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    subroots, found = [], []
    for s in order:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in trees[s]), key=lambda x: x[:3])
        subroot, paths = climb_by_hand([x[2] for x in own])
        subroots.append(subroot)
        found.append([(x[2], x[3], p) for x, p in zip(own, paths)])
    root, tops = climb_by_hand(subroots)
    out = []
    for subroot, top, own in zip(subroots, tops, found):
        for h, row, path in own:
            path = path + top
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf(row, low(row[1])) if changed else h
            for left, right in path:
                folded = digest(left, folded, right)
            out.append((row[0], h, subroot, root, digest(*[left + right for left, right in path]), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("case", ["one", "sixteen", "many", "nulls"])
def test_manifest(spark, case):
    rows = {
        "one": rows_of(1, ["a"]),
        "sixteen": rows_of(16, ["a"]) + [(k, "t", "en", "b", 1, "t", k, "o") for k in range(17)] + [(0, "t", "en", "é", 1, "t", 0, "o")],
        "many": rows_of(5000, ["hot"]) + rows_of(600, [f"s{k}" for k in range(18)]),
        "nulls": rows_of(60, [None, "", "Z", "a"]) + [(None, None, None, None, None, None, None, None)] * 3 + [(9, "twice", "en", "a", 5, "t", 1, "o")] * 2,
    }[case]
    found = merkle.tamper_report(spark.createDataFrame(rows, DOC).repartition(5))
    want = manifest_by_hand(rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert case != "many" or {v for *_, v in want} == {True, False}


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], DOC)
    assert merkle.tamper_report(empty).count() == 0 and merkle.manifest(empty).count() == 0


def whiten_by_hand(vectors, want=4):
    kept = {k: [math.floor(c * 256) for c in v] for k, v in vectors.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    dims = max(map(len, kept.values()))
    kept = {k: v + [0] * (dims - len(v)) for k, v in kept.items()}
    distinct = sorted({tuple(v) for v in kept.values()})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    x = np.array(distinct, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1][:want], vectors[:, ::-1][:, :want]
    out = {}
    for k, v in kept.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for c in range(len(values)):
            if values[c] > 1e-12 * values[0]:
                out[k, c + 1] = (n, deviation, (np.array(v) - np.array(sums) / n) @ vectors[:, c] / math.sqrt(values[c]), values[c] / (np.sum(x * x) / n))
    return out


def vectors(case):
    r = np.random.default_rng(4)
    if case == "plain":
        v = {k: (r.normal(size=12) * np.linspace(1, 3, 12)).tolist() for k in range(300)}
        v |= {1000: None, 1001: [None] + [1.0] * 11, 1002: [math.nan] * 12, 1003: [math.inf] * 12, 1004: v[5], 1005: [0.5, -0.5], 1006: []}
        return v
    if case == "flat":  # more dimensions than vectors
        return {k: r.normal(size=20).tolist() for k in range(7)}
    if case == "one direction":
        return {k: [k / 2, k * 1.0, 0.0] for k in range(50)}
    return {k: (np.outer(r.normal(size=1), [3e7, 0, 0])[0] + r.normal(size=3) * 2e7).tolist() for k in range(40)}  # sums past 64 bits


@pytest.mark.parametrize("case", ["plain", "flat", "one direction", "large"])
def test_whitening(spark, case):
    table = vectors(case)
    rows = [(k, v, k, "own") for k, v in table.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, whitened string").repartition(3)
    found = whitening.whiten(df).collect()
    want = whiten_by_hand(table)
    assert sorted((r.vec_id, r.component) for r in found) == sorted(want)
    sign = {}
    for r in found:
        n, deviation, value, explained = want[r.vec_id, r.component]
        assert r.n == n and r.deviation == (deviation if deviation < 2**63 else None) and abs(r.explained - explained) < 1e-10 and r.identity_error < 1e-8
        if abs(value) > 1e-3:
            assert sign.setdefault(r.component, np.sign(value * r.whitened)) == np.sign(value * r.whitened)
        assert abs(abs(value) - abs(r.whitened)) < 1e-7 * max(1, abs(value))


def test_repeated_components_are_found(spark):
    """Five equal deviations in the middle: one start meets only one of them."""
    scales = [9.0, 4.0, 4.0, 4.0, 4.0, 4.0] + [1.0 / k for k in range(1, 15)]
    rows = [(2 * k + s, [scales[k] * (1 - 2 * s) if i == k else 0.0 for i in range(20)]) for k in range(20) for s in (0, 1)]
    found = whitening.fit_whitening(whitening.on_lattice(spark.createDataFrame(rows, "vec_id long, x array<double>"), "x"), "x")
    top = np.array([9.0, 4.0, 4.0, 4.0]) * 256
    assert np.allclose(found.eigenvalues, 2 * top**2 / found.n, rtol=1e-3) and found.identity_error < 1e-8


def test_whitening_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, rest = sum(sizes.values()), {}, set(order)
    while rest:
        level = (total - sum(target.values())) / sum(weight[s] for s in rest)
        over = {s for s in rest if 3 * sizes[s] <= level * weight[s]}
        if not over:
            return target | {s: level * weight[s] for s in rest}
        target |= {s: 3 * sizes[s] for s in over}
        rest -= over
    return target


@pytest.fixture(scope="module")
def mix_rows():
    rows = rows_of(900, ["hot"]) + rows_of(400, ["a", "b", "é", "z", None]) + rows_of(5, ["tiny"]) + [(7, "twice over", "en", "b", 5, "t", 1, "o")] * 3
    return rows + [(None, None, None, "empty", None, None, None, None), (4, "", "en", "empty", 0, None, None, None)]


def test_mix(spark, mix_rows):
    df = spark.createDataFrame(mix_rows, DOC)
    found = mixing.plan_mix(df, n_shards=7).toPandas()
    size = {}
    for r in mix_rows:
        size[r[3]] = size.get(r[3], 0) + len(WORDS.findall(r[1] or ""))
    target = targets_by_hand(size)
    assert sorted(map(str, found.doc_id.astype("Int64"))) == sorted(str(r[0]) if r[0] is not None else "<NA>" for r in mix_rows)
    taken = {}
    for r in found.itertuples():
        (source,) = [s for s in size if size[s] == r.source_size and math.isclose(target[s], r.target, rel_tol=1e-9, abs_tol=1e-9)][:1]
        taken[source] = taken.get(source, 0) + r.taken
        assert r.taken == r.size * len(r.copies) and len(r.copies) <= 3
    assert all(abs(taken[s] - target[s]) <= 10 for s in taken) and set(taken) == set(size)
    again = mixing.mix_report(df.repartition(9)).orderBy("doc_id", "size", "taken").toPandas()
    assert again.equals(mixing.mix_report(df).orderBy("doc_id", "size", "taken").toPandas())


def test_mix_shards_are_disjoint_and_gapless(spark, mix_rows, tmp_path):
    df = spark.createDataFrame(mix_rows, DOC)
    found = mixing.mixed(df, n_shards=5).toPandas()
    for _, own in found.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert not found.duplicated(["row", "pass"]).any()
    plan = mixing.plan_mix(df, n_shards=5).toPandas()
    assert len(found) == sum(map(len, plan.copies)) and found["size"].sum() == plan.taken.sum()
    path = str(tmp_path / "mix")
    mixing.write_mix(df, path, n_shards=5)
    assert spark.read.parquet(path).groupBy("shard").count().toPandas().set_index("shard")["count"].to_dict() == found.groupby("shard").size().to_dict()
    assert mixing.mix_report(df.limit(0)).count() == 0


def test_draws_follow_the_hypergeometric_law(spark):
    urn = spark.range(4000).select(mixing.hypergeometric(F.lit(6).cast("long"), F.lit(9).cast("long"), F.lit(5).cast("long"), F.col("id")).alias("x"))
    found = {r.x: r["count"] / 4000 for r in urn.groupBy("x").count().collect()}
    law = {x: math.comb(6, x) * math.comb(9, 5 - x) / math.comb(15, 5) for x in range(6)}
    assert all(abs(found.get(x, 0) - p) < 4 * math.sqrt(p * (1 - p) / 4000) for x, p in law.items())
    large = spark.range(300).select(mixing.hypergeometric(F.lit(10**7).cast("long"), F.lit(10**6).cast("long"), F.lit(5 * 10**6).cast("long"), F.col("id")).alias("x"))
    mean, deviation = 5e6 * 10 / 11, math.sqrt(5e6 * 10 / 11 / 11 * 6 / 11)
    row = large.agg(F.avg("x"), F.stddev("x")).first()
    assert abs(row[0] - mean) < 4 * deviation / math.sqrt(300) and 0.8 < row[1] / deviation < 1.2


def test_splitting_tree_keeps_quotas(spark):
    counts = [17, 0, 250, 3, 1, 90]
    tree = mixing.splitting_tree(spark.createDataFrame(list(enumerate(counts)), "rank long, n long"), len(counts), 11, 1).toPandas()
    assert tree.groupby("rank")["n"].sum().tolist() == counts and len(tree) == 66 and (tree["n"] >= 0).all()
    shards = tree.groupby("shard")["n"].sum()
    assert shards.max() - shards.min() <= 1
