"""Graph documents as JSON or Parquet tables, and content manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import EDGE_KINDS, TABLES, document_schema

#: What each list of a graph document is sorted by.
ORDER = {"edges": ("kind_rank", "from", "to", "source", "statusCode", "fieldName"), "diagnostics": ("kind", "first_node", "message")}


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of one JSON graph document. A multi-line file is one task; beyond demonstration size use the Parquet tables."""
    whole = spark.read.schema(document_schema()).json(path, multiLine=True)
    return {name: whole.select(F.explode(name).alias("x")).select("x.*") for name in TABLES}


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in TABLES.items()}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Parquet, edges partitioned by kind."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy(*(["kind"] if name == "edges" else [])).parquet(f"{folder}/{name}")


def sorted_rows(name: str, df: DataFrame) -> DataFrame:
    if name == "edges":
        df = df.withColumn("kind_rank", F.array_position(F.array(*map(F.lit, EDGE_KINDS)), F.col("kind")))
    if name == "diagnostics":
        df = df.withColumn("first_node", F.get("nodeIds", F.lit(0)))
    return df.orderBy(*ORDER.get(name, ("id",))).drop("kind_rank", "first_node")


def write_json(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON object for each row, nulls left out, in the document's order."""
    for name, df in tables.items():
        sorted_rows(name, df).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")


def manifest(files: DataFrame, repos: DataFrame | None = None, versions: dict[str, str] | None = None) -> DataFrame:
    """(path, sha256) of files (path, text), a null text being a file that can't be read; also the head commits of repos (repo, head), nothing for one without commits, and versions by
    key, so that a new head or version is a change."""
    out = files.select("path", F.coalesce(F.sha2("text", 256), F.lit("unreadable")).alias("sha256"))
    if repos is not None:
        out = out.union(repos.select(F.concat(F.lit("repo:"), "repo"), F.coalesce("head", F.lit(""))))
    if versions:
        out = out.union(files.sparkSession.createDataFrame(sorted(versions.items()), "path string, sha256 string"))
    return out


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of paths that were added, removed or changed."""
    both = old.select("path", F.col("sha256").alias("was")).join(new.select("path", F.col("sha256").alias("now")), "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


#: The largest file that snippets are read from, and the most lines on each side.
MOST_BYTES, MOST_CONTEXT = 5 * 1024 * 1024, 50


def snippets(locations: DataFrame, files: DataFrame, context: int = 10, most_chars: int = 1999, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(node_id, line, text) of the up to 50 lines on each side of each location (node_id, path, line); a line past the end is the last one, a null line the first. A line ends at a line feed, a carriage return or both, and a text's
    last line end starts no new line. Empty files have no lines, and those of more than most_bytes are refused (snippet_refusals names them)."""
    context = max(0, min(MOST_CONTEXT, context))
    split = F.split(F.regexp_replace("text", "(\r\n|\r|\n)\\z", ""), "\r\n|\r|\n")
    target = F.least(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)), F.size("lines"))
    readable = files.filter((F.col("text") != "") & (F.octet_length("text") <= most_bytes)).select("path", split.alias("lines"))
    near = locations.join(readable, "path").withColumn("target", target)
    low, high = F.greatest(F.col("target") - context, F.lit(1)), F.least(F.col("target") + context, F.size("lines"))
    rows = near.select("node_id", F.posexplode(F.slice("lines", low, high - low + 1)).alias("i", "raw"), low.alias("low"))
    cut = F.when(F.length("raw") > most_chars, F.concat(F.substring("raw", 1, most_chars), F.lit("…"))).otherwise(F.col("raw"))
    number = (F.col("i") + F.col("low")).cast("int")
    return rows.select("node_id", number.alias("line"), F.concat(F.format_string("%5d| ", number), cut).alias("text"))


def snippet_refusals(locations: DataFrame, files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(node_id, path, problem) of locations (node_id, path) whose file is missing, can't be read (null text) or is too large. A location without a path has no file."""
    sizes = files.select("path", F.coalesce(F.octet_length("text"), F.lit(-1)).alias("size"))
    problem = F.when(F.col("size").isNull(), "missing").when(F.col("size") < 0, "unreadable").when(F.col("size") > most_bytes, "too large")
    return locations.select("node_id", "path").join(sizes, "path", "left").select("node_id", "path", problem.alias("problem")).filter("problem is not null")
