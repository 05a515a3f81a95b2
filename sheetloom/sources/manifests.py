"""From request manifests to typed rows, and results back to files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("pdfs_to_stitch", "match_lines", "segmentation_info", "parsed_text", "grid_lines")
#: What each kind of file has to end in.
SUFFIXES = {k: ".pdf" if k == "pdfs_to_stitch" else ".json" for k in KINDS}
_BOX = "array<double>"
SCHEMAS = {
    "grid_lines": f"text string, bbox {_BOX}, grid {_BOX}",
    "match_lines": f"type string, actual_dashed_line {_BOX}",
    "segmentation_info": f"segmented_area {_BOX}",
    "parsed_text": "parsed_text array<struct<x0:double,y0:double,x1:double,y1:double>>",
}


def explode_manifest(manifests: DataFrame) -> DataFrame:
    """(set_id, page_idx, kind, file_key) for every file of ``files``; positions are page numbers, absent lists give nothing."""
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"files.{k}").alias("keys")) for k in KINDS])
    return manifests.select("set_id", F.explode(lists).alias("l")).select("set_id", "l.kind", F.posexplode("l.keys").alias("page_idx", "file_key")).select("set_id", "page_idx", "kind", "file_key")


def validate_suffix(files: DataFrame) -> DataFrame:
    """Add error: 'suffix' for a key that does not end as its kind asks (a null key neither), else null.

    A grid file that is no JSON keeps its place as a page without lines.
    """
    wanted = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    fits = F.coalesce(F.endswith(F.col("file_key"), F.element_at(wanted, F.col("kind"))), F.lit(False))
    return files.withColumn("error", F.when(~fits, "suffix"))


def read_entity_json(spark: SparkSession, files: DataFrame, kind: str, root: str, paths: list[str] | str) -> DataFrame:
    """(set_id, page_idx, ord, fields of ``kind``) from the JSON files of one kind under ``root``.

    ``paths`` are what Spark reads (folders or globs), ``file_key`` is the rest of a
    file's path after ``root``. A file is one array of records (one object for parsed
    text); a broken or empty one gives its page a single row with null fields.
    """
    raw = spark.read.schema(SCHEMAS[kind]).option("multiLine", True).option("mode", "PERMISSIVE").json(paths).withColumn("_path", F.col("_metadata.file_path"))
    raw = raw.withColumn("_key", F.substring_index("_path", root.rstrip("/") + "/", -1))
    if kind == "parsed_text":
        raw = raw.select("_key", F.posexplode_outer("parsed_text").alias("ord", "t")).select("_key", "ord", "t.*")
    else:
        # records of one file keep their order: it is read by one task, in order
        from pyspark.sql import Window

        raw = raw.withColumn("_id", F.monotonically_increasing_id())
        raw = raw.withColumn("ord", F.row_number().over(Window.partitionBy("_key").orderBy("_id")) - 1).drop("_id", "_path")
    wanted = files.where(F.col("kind") == kind).select("set_id", "page_idx", F.col("file_key").alias("_key"))
    return wanted.join(raw, "_key", "left").drop("_key")


def write_packed(files: DataFrame, path: str) -> None:
    """Files (file_key, content) as lines of a few compressed files: a cluster lists, opens and plans a task for every small file, which takes far longer than to read it."""
    files.select("file_key", "content").write.option("compression", "gzip").json(path)


def read_packed_json(spark: SparkSession, files: DataFrame, kind: str, paths: list[str] | str) -> DataFrame:
    """read_entity_json for files that write_packed put together; a key that is not there gives a row with null fields too."""
    packed = spark.read.schema("file_key string, content string").json(paths).withColumnRenamed("file_key", "_key")
    wanted = files.where(F.col("kind") == kind).select("set_id", "page_idx", F.col("file_key").alias("_key"))
    parsed = F.from_json("content", SCHEMAS[kind])["parsed_text"] if kind == "parsed_text" else F.from_json("content", f"array<struct<{_typed(SCHEMAS[kind])}>>")
    rows = wanted.join(packed, "_key", "left").select("set_id", "page_idx", F.posexplode_outer(parsed).alias("ord", "_r"))
    return rows.select("set_id", "page_idx", "_r.*", "ord")


def _typed(schema: str) -> str:
    """A column list as the fields of a struct type."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", schema)


def grid_rows(records: DataFrame) -> DataFrame:
    """Flat grid lines from records of read_entity_json, pages without lines left out."""
    box = lambda a, p: [F.get(F.col(a), i).cast("long").alias(p + n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    rows = records.where("text is not null and size(bbox) = 4 and size(grid) = 4")
    return rows.select("set_id", "page_idx", F.col("ord").alias("line_ord"), "text", *box("bbox", "b"), *box("grid", "g"))


def write_placements(placed: DataFrame, path: str) -> None:
    """Flat placements as Parquet."""
    placed.write.parquet(path)


def write_json_results(results: DataFrame, path: str) -> None:
    """One JSON object per set, each in its own line."""
    results.select(F.to_json(F.struct(*results.columns)).alias("value")).write.text(path)
