"""Merkle manifest of a table from concatenated-level strings.

Rows are leaves, numbered inside their tree in order. Every aligned block of ``SPAN``
nodes keeps each of its levels as one hex string, in which a node is a substring of 64
letters: a run of ``FANOUT`` nodes is one substring, whose hash is a parent, and what
flanks a node in its run are its siblings. The nodes above the blocks are the nodes of the next
round, in blocks again, until every tree is one block; the roots of the trees are
the leaves of one more tree, built in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import ordered_slots
from ._util import checkpointed, fresh

HEX, FANOUT = 64, 16
SPAN = FANOUT * FANOUT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields one after the other, each ``-`` where null, else its UTF-8 byte count, a colon and its value."""
    parts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts]), 256)


def _parents(level: str) -> Column:
    """The level above, from one of whole and last runs."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / (HEX * FANOUT)).cast("int") - 1)
    raw = F.col(level).cast("binary")
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(raw, i * (HEX * FANOUT) + 1, F.lit(HEX * FANOUT)), 256)), "")


def _flanks(level: str, at: Column) -> Column:
    """What lies left and right of node ``at`` of a block in its run."""
    start, place = at - at % FANOUT, (at % FANOUT).cast("int")
    left = F.substring(F.col(level), (start * HEX + 1).cast("int"), place * HEX)
    right = F.substring(F.col(level), ((at + 1) * HEX + 1).cast("int"), (F.lit(FANOUT - 1) - place) * HEX)
    return F.struct(left.alias("left"), right.alias("right"))


def climb(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, from the leaves up, and (tree, root).

    ``nodes`` has tree, pos (gapless from 0 in each tree), node (a hash), n (nodes of
    the tree, at most ``most``) and own, which stays with the leaves.
    """
    rounds, roots = [], None
    while True:
        blocks = nodes.groupBy("tree", "n", F.expr(f"pos div {SPAN}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "node", "own"))).alias("members"))
        blocks = blocks.withColumn("level0", F.array_join(F.transform("members", lambda m: m["node"]), ""))
        blocks = blocks.withColumn("level1", F.when(F.col("n") > 1, _parents("level0")))
        blocks = blocks.withColumn("top", F.coalesce(F.when(F.col("n") > FANOUT, _parents("level1")), "level1", "level0"))
        blocks = checkpointed(blocks)
        rounds.append(blocks)
        done = blocks.where(F.col("n") <= SPAN).select("tree", F.col("top").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        if most <= SPAN:
            return rounds, roots
        most = -(-most // SPAN)
        nodes = blocks.where(F.col("n") > SPAN).select("tree", F.col("block").alias("pos"), F.col("top").alias("node"), F.ceil(F.col("n") / SPAN).alias("n"), F.lit(None).cast("string").alias("own"))


NONE = "array<struct<left:string,right:string>>"


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, pos, node, own, path, subroot) of every leaf: path holds the flanks met on each level up to the root.

    ``above`` has the path and the subroot from which each tree goes on; a tree's last block takes
    them up and hands them down, block by block, so no join is on trees alone but of such blocks.
    """
    none = F.array().cast(NONE)
    found = None
    for blocks in reversed(rounds):
        upper = blocks.where(F.col("n") <= SPAN).join(above.select("tree", F.col("path").alias("upper"), "subroot"), "tree")
        if found is not None:
            on = found.select("tree", F.col("pos").alias("block"), F.col("path").alias("upper"), "subroot")
            upper = upper.unionByName(blocks.where(F.col("n") > SPAN).join(on, ["tree", "block"]))
        each = upper.select("tree", "n", "level0", "level1", "upper", "subroot", F.explode("members").alias("m"))
        at = F.col("m.pos") % SPAN
        path = F.concat(
            F.when(F.col("n") > 1, F.array(_flanks("level0", at))).otherwise(none),
            F.when(F.col("n") > FANOUT, F.array(_flanks("level1", F.floor(at / FANOUT)))).otherwise(none),
            F.col("upper"),
        )
        found = each.select("tree", "m.pos", "m.node", "m.own", path.alias("path"), "subroot")
    return found


def fold(path: str, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def manifest(df: DataFrame, fields: tuple[str, ...] = FIELDS, tree_by: str = "source", order: str = "doc_id", **carried: Column) -> DataFrame:
    """(order, leaf, the carried columns, path, subroot, root) of every row.

    A leaf hashes ``fields``. Leaves of a value of ``tree_by`` ascend by ``order``, null first and
    ties by hash, under a subroot; subroots ascend by that value in bytes, null first, under
    the root. ``carried`` are further columns computed from a row, as the hash of a changed copy.
    Rows alike are leaves each; an empty table has no root and gives no rows; columns besides
    ``fields``, ``tree_by`` and ``order`` are not looked at. A tree that holds most of
    the rows is numbered in ranges and hashed in blocks by many tasks.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col(tree_by).cast("string")), F.lit("0"))
    rows = df.select(tree.alias("tree"), F.col(order).alias("at"), leaf_hash([F.col(c) for c in fields]).alias("node"), F.struct(F.col(order).alias("id"), *[c.alias(k) for k, c in carried.items()]).alias("own"))
    rows = checkpointed(ordered_slots(rows, ["tree"], ["at", "node"], "pos", "n"))
    rounds, subroots = climb(rows, rows.agg(F.max("n")).first()[0] or 0)
    subroots = checkpointed(ordered_slots(subroots.select("tree", F.col("root").alias("node"), F.lit("").alias("all")), ["all"], ["tree"], "pos", "n"))
    trees = subroots.count()
    tops, roots = climb(subroots.select(F.col("all").alias("tree"), "pos", "node", "n", F.col("tree").alias("own")), trees)
    root = roots.first()
    above = descend(tops, df.sparkSession.createDataFrame([("", [], None)], f"tree string, path {NONE}, subroot string"))
    found = descend(rounds, above.select(F.col("own").alias("tree"), "path", F.col("node").alias("subroot")))
    return found.select(
        F.col("own.id").alias(order),
        F.col("node").alias("leaf"),
        *[F.col(f"own.{k}").alias(k) for k in carried],
        "path",
        "subroot",
        F.lit(root["root"] if root else None).cast("string").alias("root"),
    )


def tamper_report(df: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Documents whose doc_id has a crc32 that ``every`` divides are changed: A-Z of the text in lower
    case. ``folded_root`` is worked out from the leaf of the (changed) document and the siblings of
    the original. A null doc_id has no crc32, so it is not changed, nor is a null or empty text.
    """
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0
    lowered = leaf_hash([F.translate(F.col(c), UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS])
    (other,) = fresh(df.select(*FIELDS), "changed_leaf")
    found = manifest(df, **{other: F.when(changed, lowered)})
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold("path", F.coalesce(other, "leaf")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Runs and proofs level by level; the checksum of doc_id is the usual shift register of 32 bits.
ORACLE = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN doc_id IS NULL THEN false ELSE list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))) END AS reg
  FROM documents),
hashed AS (
  SELECT doc_id, source, reg IS NOT NULL AND xor(reg, 4294967295) % 5 = 0 AS changed,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered
  FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM docs)),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
levels AS (
  SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM levels WHERE n > 1 GROUP BY tree, lvl, pos // 16, n),
subroots AS (SELECT tree, h AS subroot FROM levels WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, tree AS pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY lvl, pos // 16, n),
runs AS (
  SELECT tree, lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM levels WHERE n > 1 GROUP BY tree, lvl, pos // 16),
top_runs AS (
  SELECT lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM tops WHERE n > 1 GROUP BY lvl, pos // 16),
steps AS (
  SELECT l.tree, l.pos, r.lvl, (l.pos // CAST(pow(16, r.lvl) AS BIGINT)) % 16 AS k, r.hs
  FROM leaves l JOIN runs r ON r.tree = l.tree AND r.run = l.pos // CAST(pow(16, r.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT l.tree, l.pos, 100 + r.lvl, (l.tree // CAST(pow(16, r.lvl) AS BIGINT)) % 16, r.hs
  FROM leaves l JOIN top_runs r ON r.run = l.tree // CAST(pow(16, r.lvl + 1) AS BIGINT)),
paths AS (
  SELECT tree, pos, list({'a': array_to_string(hs[1:k], ''), 'b': array_to_string(hs[k + 2:], '')} ORDER BY lvl) AS path FROM steps GROUP BY tree, pos),
folds AS (
  SELECT l.tree, l.pos, 0 AS i, CASE WHEN changed THEN lowered ELSE leaf END AS h, path FROM leaves l LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos
  UNION ALL
  SELECT tree, pos, i + 1, sha256(path[i + 1].a || h || path[i + 1].b), path FROM folds WHERE i < len(path))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(f.path, lambda s: s.a || s.b), ''), '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN folds f ON f.tree = l.tree AND f.pos = l.pos AND f.i = coalesce(len(f.path), 0), (SELECT h AS root FROM tops WHERE n = 1)
"""
