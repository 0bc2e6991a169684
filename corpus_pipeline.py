"""Corpus pipeline: quality rules, near-duplicate removal, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs; all but
the last return the columns of documents. Stages judge rows, not doc_ids: rows with a null or repeated doc_id are kept or dropped each
for itself, null texts count as empty, other columns stay as they are (also ones with the names of counts or rates), and an empty table
gives an empty one. SQL can express none of the stages as a whole, so ORACLE_SQL is None; tests hold the operators against brute-force versions, and the stages against what they
have to keep and drop on small tables.

A stage's tables in the shared folder are removed when the next stage begins, unless what it gets still reads them: so each stage's result has to be written before the next one, as run() does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm import mixing, packing, passages, quality, simhash
from arcweave.llm.common import WRITTEN, bounded_batches, discard, materialize, read_table
from arcweave.llm.tokens import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the stages before have written for themselves.
LEFT: list[str] = []


def tidy(stage: Stage) -> Stage:
    """The stage, which first removes the tables of stages before that docs doesn't read."""

    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        done = [table for table in LEFT if not any(table.rpartition("/")[2] in file for file in read)]
        discard(spark, done)
        before = set(WRITTEN)
        out = stage(spark, docs, sf_dir)
        LEFT[:] = [table for table in LEFT if table not in done] + [table for table in WRITTEN if table not in before]
        return out

    return tidied


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, own): all columns of a row in own, under a number that is the row's alone; written, so that the number stays."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("doc_id"), F.struct(*docs.columns).alias("own")), "numbered")


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep; empty ones fail. Equal rows have one verdict."""
    bounded_batches(spark)
    judged = quality.judge(docs.select("doc_id", "text", "lang", "source", F.struct(*docs.columns).alias("own")), carry=["own"])
    return judged.filter("kept").select("own.*")


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with a similarity of 0.8: the one of the least doc_id. Documents without words are one group."""
    rows = numbered(docs)
    found = simhash.near_duplicates_verified(rows.select("doc_id", "own.text"))
    order = F.struct(F.col("own.doc_id").isNull().alias("unnamed"), F.col("own.doc_id").alias("id"), F.col("doc_id").alias("row"))
    first = rows.select("doc_id", order.alias("order")).join(found, "doc_id").groupBy("component_id").agg(F.min("order").alias("first"))
    return rows.join(first.select(F.col("first.row").alias("doc_id")), "doc_id", "left_semi").select("own.*")


@tidy
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document (in the order of docs) has; a document that has no word left goes."""
    rows = numbered(docs)
    found = passages.repeated_passages(rows.select("doc_id", "own.text"), distinct_ids=True)
    cut = passages.cut_passages(rows.select("doc_id", "own.text", "own"), found)
    return cut.select(*(F.col("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns))


@tidy
def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by their rates for the good and poor tokens that there are and no toxic ones; no document is repeated."""
    wanted = docs.select("doc_id", "text", F.struct(*docs.columns).alias("own"))
    rates = mixing.mix(wanted, read_table(spark, sf_dir, "labels"), multiples={"good": 1.0, "poor": 1.0, "toxic": 0.0}, most_rate=1.0, nearest=True, carry=["own"])
    return rates.filter("copies > 0").select("own.*")


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences."""
    bounded_batches(spark)
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("mixing", mixing_rates), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, results = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        results.append(WRITTEN[-1])
        discard(spark, results[:-1])
        results = results[-1:]
    return docs
