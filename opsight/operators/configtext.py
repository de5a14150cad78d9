"""Cleaning exported configuration text: dangling references and blocks to keep.

Lines are rows ``(file, line_no, line)``. Where a block starts and ends is found with
counts per chunk of lines, so one very long file is worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The text patterns of the configuration language.
GRANTS = r'resource "\w*grants" "([^"]+)"'
GRANT_REFERENCE = r"^\w*grants\."
DEPENDS_ON = r"depends_on\s*=\s*\["
TABLE_BLOCK = r'^resource "\w*sql_table" ".*" \{'
BLOCK_END = r"^\s*\}$"
NOT_EXTERNAL = r'table_type\s*=\s*"(MANAGED|VIEW)"|view_definition'
CHUNK = 100_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Config files as numbered lines.

    Files are read in splits. A line's number is its place in its split plus the lines of
    the file's splits before it, so no task reads more than a split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )
    counts = lines.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    in_file = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("file", "_split", F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_before"))
    in_split = F.row_number().over(Window.partitionBy("file", "_split").orderBy("_at")) - 1
    numbered = lines.withColumn("_place", in_split).join(before, ["file", "_split"])
    return numbered.select("file", (F.col("_before") + F.col("_place")).cast("bigint").alias("line_no"), "line")


def declared_names(lines: DataFrame) -> DataFrame:
    return (
        lines.filter(F.col("line").rlike(GRANTS))
        .select(F.regexp_extract("line", GRANTS, 1).alias("name"))
        .distinct()
    )


def drop_dangling(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """Dependency lists without references to undeclared grants; a list left empty goes with its line.

    Only lines with a list are taken apart; their references meet the declared names
    in a join and are put back in order.
    """
    key = ["file", "line_no"]
    listed = lines.filter(F.col("line").rlike(DEPENDS_ON))
    inner = F.regexp_replace(F.regexp_replace("line", r"^[^\[]*\[", ""), r"\].*", "")
    refs = (
        listed.select(*key, F.posexplode(F.split(inner, ",")).alias("position", "token"))
        .withColumn("token", F.regexp_replace("token", r"^\s+|\s+$", ""))
        .filter("token <> ''")
        .withColumn("name", F.when(F.col("token").rlike(GRANT_REFERENCE), F.regexp_replace("token", GRANT_REFERENCE, "")))
    )
    known = declared.select("name", F.lit(True).alias("declared"))
    kept = (
        refs.join(known, "name", "left")
        .filter("name is null or declared")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("position", "token"))).alias("kept"))
    )
    tokens = F.array_join(F.transform("kept", lambda x: x["token"]), ", ")
    cleaned = F.concat(F.regexp_replace("line", r"\[.*", ""), F.lit("["), tokens, F.lit("]"))
    rewritten = listed.join(kept, key).select(*key, cleaned.alias("line"))
    others = lines.filter(~F.coalesce(F.col("line").rlike(DEPENDS_ON), F.lit(False)))
    return others.select(*key, "line").unionByName(rewritten)


def _with_block(lines: DataFrame, chunk: int) -> DataFrame:
    """Add ``block``: how many table blocks have started in the file up to this line."""
    starts = F.col("line").rlike(TABLE_BLOCK).cast("int")
    marked = lines.withColumns({"_start": F.coalesce(starts, F.lit(0)), "_chunk": F.floor(F.col("line_no") / chunk)})
    before = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("file", "_chunk")
        .agg(F.sum("_start").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy("file", "_chunk").orderBy("line_no")
    return (
        marked.join(offsets, ["file", "_chunk"])
        .withColumn("block", F.col("_offset") + F.sum("_start").over(inside))
        .drop("_start", "_chunk", "_offset")
    )


def _surviving(lines: DataFrame, chunk: int) -> DataFrame:
    """Lines that stay, with ``within``: whether the line belongs to a table block.

    A block ends at its first line that is only ``}``; one that is cut off by the next
    block or the end of the file is dropped, like managed tables and views.
    """
    numbered = _with_block(lines, chunk)
    key = ["file", "block"]
    line_no, is_end = F.col("line_no"), F.col("line").rlike(BLOCK_END)
    internal_at = F.min(F.when(F.col("line").rlike(NOT_EXTERNAL), line_no))
    blocks = (
        numbered.filter("block > 0")
        .groupBy(*key)
        .agg(F.min(F.when(is_end, line_no)).alias("end_no"), internal_at.alias("internal_no"))
    )
    placed = numbered.join(blocks, key, "left")
    end_no, internal_no = F.col("end_no"), F.col("internal_no")
    within = (F.col("block") > 0) & (end_no.isNull() | (line_no <= end_no))
    external = end_no.isNotNull() & (internal_no.isNull() | (internal_no > end_no))
    return placed.withColumn("within", within).filter(~F.col("within") | external)


def external_blocks(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Lines outside table blocks, and the blocks of external tables."""
    return _surviving(lines, chunk).select("file", "line_no", "line")


def external_tables(lines: DataFrame, declared: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """:func:`external_blocks` with dangling references dropped inside the blocks."""
    kept = _surviving(lines, chunk)
    columns = ["file", "line_no", "line"]
    inside = drop_dangling(kept.filter("within").select(*columns), declared)
    return inside.unionByName(kept.filter("not within").select(*columns))
