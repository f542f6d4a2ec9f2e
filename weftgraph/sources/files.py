"""Source trees as tables: inventories, line ranges, JSON folders and front matter, read by Spark from any file system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: extensions of searchable files and folders that a scan leaves out
EXTENSIONS = [
    ".cs", ".csproj", ".sln", ".js", ".jsx", ".ts", ".tsx", ".aspx", ".ascx", ".master", ".sql", ".json", ".xml", ".config", ".md", ".txt", ".yaml",
    ".yml",
]
LEFT_OUT = [
    ".git", ".svn", ".vs", "bin", "obj", "node_modules", "packages", "dist", "build", "out", "target", "vendor",
]


def source_files(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS, left_out: list[str] = LEFT_OUT) -> DataFrame:
    """(path, extension, bytes, line_count, source_hash, text) of each file below root, paths relative with forward slashes.

    Extensions and folders match whatever their case; a link is followed only where the file system does so itself.
    Spark's reader skips files of no bytes, so they have no row; bytes that are no UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    extension = F.regexp_extract(F.element_at(parts, -1), r"(\.[^.]+)$", 1)
    text = F.decode("content", "UTF-8")
    lines = F.size(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1))
    kept = files.where(extension.isin(extensions) & ~F.arrays_overlap(folders, F.array(*map(F.lit, left_out))))
    return kept.select(path.alias("path"), extension.alias("extension"), F.col("length").alias("bytes"), lines.alias("line_count"), F.sha2("content", 256).alias("source_hash"), text.alias("text"))


def file_range(files: DataFrame, start: int, count: int) -> DataFrame:
    """(path, line, content, has_more): lines start to start + count - 1 (from 1; count is held between 1 and 2,000)."""
    first, most = max(1, start), min(2000, max(1, count))
    lines = F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n", -1)
    cut = files.select("path", F.slice(lines, first, most).alias("cut"), (F.size(lines) > first + most - 1).alias("has_more"))
    return cut.select("path", "has_more", F.posexplode("cut").alias("at", "content")).select("path", (F.col("at") + first).alias("line"), "content", "has_more")


def json_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(key, the schema's columns): one row a JSON file, the key its stem; a file that isn't such JSON has nulls."""
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(folder)
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.select(stem.alias("key"), F.from_json("value", schema).alias("r")).select("key", "r.*")


def front_matter(text: Column) -> Column:
    """The lines between a leading --- and the next one as a map of trimmed key: value pairs, first key kept; null without one."""
    block = F.regexp_extract(text, r"\A\x{FEFF}?---[ \t]*\r?\n(?s:(.*?))\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    pairs = F.filter(F.transform(F.split(block, r"\r?\n"), lambda s: F.struct(F.trim(F.regexp_extract(s, r"^([^:#\s][^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(s, r"^[^:]*:(.*)$", 1)).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda o: o["k"] == p["k"]))
    return F.when(block != "", F.map_from_entries(first))
