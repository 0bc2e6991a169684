"""Token ids in Arrow stream files with fixed-size-list batches (operator 6).

A shard file is one Arrow IPC stream of columns ids and mask, both fixed-size lists of `row_tokens`; all record batches but the
last have `batch_rows` rows and are not compressed, so all have one size on disk and any row's place follows from its number:
a memory map gives rows without copying or decoding. Ids are uint16 while the vocabulary allows it. The mask tells tokens from the
padding of a shard's last row. A shard's documents follow each other gaplessly in ascending doc_id; the manifest (one row for
each document, a Parquet table beside the shards) has each document's shard, place and length.

Shards are ranges of doc_id with cut points from approximate quantiles of the ids, so their number follows the input. Files are
written to an attempt's own name and then moved, so a lost or repeated task leaves no torn shard. Equal doc_ids are ordered by
text; null doc_ids come first, null texts are empty (the end id alone).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, shared_dir, slices
from .ranges import by_ranges
from .tokens import encoder, tokenizer_path

ROW_TOKENS, BATCH_ROWS = 1024, 64
MANIFEST = "doc_id long, shard long, path string, place long, start_in_shard long, n_tokens long, shard_tokens long"


def file_schema(row_tokens: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), row_tokens)), ("mask", pa.list_(pa.bool_(), row_tokens))])


class ShardWriter:
    """Ids go in, full batches go out to the stream file."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, row_tokens: int, batch_rows: int, wide: bool):
        self.schema, self.row_tokens, self.batch = file_schema(row_tokens, wide), row_tokens, row_tokens * batch_rows
        self.fs, self.path, self.own = fs, path, f"{path}.{uuid.uuid4().hex}"
        self.sink = fs.open_output_stream(self.own)
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= self.batch:
            flat = np.concatenate(self.held)
            cut = len(flat) // self.batch * self.batch
            for at in range(0, cut, self.batch):
                self._write(flat[at : at + self.batch])
            self.held, self.n_held = [flat[cut:]], len(flat) - cut

    def _write(self, flat: np.ndarray) -> None:
        padded = -len(flat) % self.row_tokens
        ids = np.concatenate([flat, np.zeros(padded, flat.dtype)]) if padded else flat
        mask = np.arange(len(ids)) < len(flat)
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x.astype(f.type.value_type.to_pandas_dtype())), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.stream.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held))
        self.stream.close()
        self.sink.close()
        self.fs.move(self.own, self.path)


class ShardReader:
    """Rows of a shard by number; in a memory map nothing is copied until it is asked for."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.file = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        size = self.file.size()
        reader = pa.ipc.open_stream(self.file)
        self.schema, self.row_tokens, self.first = reader.schema, reader.schema.field("ids").type.list_size, self.file.tell()
        self.rows_in_batch = reader.read_next_batch().num_rows
        self.batch_bytes, self.size = self.file.tell() - self.first, size

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from token `start` on."""
        per, out = self.row_tokens * self.rows_in_batch, []
        while n > 0:
            at = self.first + start // per * self.batch_bytes
            self.file.seek(at)
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
            flat = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
            out.append(flat[start % per : start % per + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, keep_space: bool = False, wide: bool = False, row_tokens: int = ROW_TOKENS, batch_rows: int = BATCH_ROWS, bytes_per_shard: int = 24_000_000) -> DataFrame:
    """Encodes (doc_id, text) into shards under folder (a URI that all executors reach) and returns the manifest, which lies beside
    the shards. wide: 32-bit ids, for vocabularies over 65,536."""
    spark = docs.sparkSession
    base, scheme = folder.rstrip("/"), folder.split("://")[0] if "://" in folder else ""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(base if scheme else f"file://{base}")
        encode, dtype = encoder(tokenizer, keep_space).encode, np.uint32 if wide else np.uint16
        end, shard, writer, rows = np.array([end_id], dtype), None, None, []

        def finish() -> pa.RecordBatch:
            writer.close()
            total = writer.n
            ids, starts, counts = zip(*rows, strict=True)
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shard] * n, pa.int64()), pa.array([writer.path] * n), pa.array(range(n), pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array([total] * n, pa.int64())], ["doc_id", "shard", "path", "place", "start_in_shard", "n_tokens", "shard_tokens"])

        for part, texts in slices(batches, most_chars=4_000_000):
            for doc_id, own, ids in zip(part.column("doc_id").to_pylist(), part.column("range_id").to_pylist(), encode(texts), strict=True):
                if own != shard:
                    if writer:
                        yield finish()
                    shard, rows = own, []
                    fs.create_dir(f"{root}/shards", recursive=True)
                    writer = ShardWriter(fs, f"{root}/shards/{shard:08d}.arrows", row_tokens, batch_rows, wide)
                rows.append((doc_id, writer.n, len(ids) + 1))
                writer.add(np.concatenate([ids.astype(dtype), end]))
        if writer:
            yield finish()

    cut = by_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bytes_per_shard)
    cut.mapInArrow(write, MANIFEST).write.parquet(f"{base}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def read_token_files(manifest: DataFrame, scheme: str) -> DataFrame:
    """One row for each document of the manifest, its ids taken from the shard files: doc_id, start (ids of all documents before
    it), n_tokens and ids_crc32. The driver only sees one number for each shard."""
    shards = sorted(manifest.select("shard", "shard_tokens").distinct().collect())
    before, total = {}, 0
    for shard, n in shards:
        before[shard] = total
        total += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, reader, path = None, None, None
        for batch in batches:
            out = []
            for own, shard, start, n in zip(*(batch.column(c).to_pylist() for c in ("path", "shard", "start_in_shard", "n_tokens")), strict=True):
                if own != path:
                    fs = fs or pa.fs.FileSystem.from_uri(f"{scheme}{own}")[0]
                    reader, path = ShardReader(fs, own), own
                ids = reader.ids(start, n)
                out.append((before[shard] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([], [], [])))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as Arrow stream files in the shared folder and read back."""
    folder = f"{shared_dir(spark)}/arcweave-tokens-{uuid.uuid4().hex}"
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    scheme = folder.split("://")[0] + "://" if "://" in folder else "file://"
    return read_token_files(manifest, scheme)
