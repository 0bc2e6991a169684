"""Helpers that the corpus operators share: reading tables, writing stages to the shared folder, task-side iteration."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that goes to Python at once; a longer text makes a batch of its own.
BATCH_BYTES = 8_000_000
#: A key with more than one in HOT_SHARE of all rows counts as hot; there are fewer of them than HOT_SHARE.
HOT_SHARE, LEAST_HOT = 2000, 1000


def bounded_batches(spark: SparkSession) -> SparkSession:
    """From now on Spark sends rows to Python in batches of BATCH_BYTES at most, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the tables that this session has written, in order.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a new folder (tests) and a
    cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it from there: later jobs neither repeat the work nor lose it
    with an executor."""
    spark = bounded_batches(df.sparkSession)
    path = f"{shared_dir(spark)}/arcweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove written tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    WRITTEN[:] = [path for path in WRITTEN if path not in set(paths)]


def join_counted(big: DataFrame, keyed: DataFrame, on: str, how: str = "inner", n: str = "n") -> DataFrame:
    """big joined with keyed (inner or left_semi), which is written already and has one row for each key with the number n of its rows in big. Hot
    keys go by broadcast, at most HOT_SHARE rows by their definition, so that no task gets all rows of one; the others are shuffled."""
    total = keyed.agg(F.sum(n)).first()[0] or 0
    limit = max(LEAST_HOT, total // HOT_SHARE)
    hot, cold = keyed.filter(F.col(n) > limit).drop(n), keyed.filter(F.col(n) <= limit).drop(n)
    if hot.isEmpty():
        return big.join(cold, on, how)
    rest = big.join(F.broadcast(hot.select(on)), on, "left_anti")
    return big.join(F.broadcast(hot), on, how).unionByName(rest.join(cold, on, how))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most_chars: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches whose texts have about most_chars bytes together (one text at least), with the texts; null: empty."""
    for batch in batches:
        lengths = batch.column(text)
        sizes = pa.compute.binary_length(lengths).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate([*sizes, None]):
            if n is None or (held and held + n > most_chars):
                if i > start:
                    part = batch.slice(start, i - start)
                    yield part, [x or "" for x in part.column(text).to_pylist()]
                start, held = i, 0
            held += n or 0
        pa.default_memory_pool().release_unused()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
