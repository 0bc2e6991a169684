"""Rows in one total order over all tasks, and SHA-256 of byte strings that arrive in pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits of a row's place that count within its part; the part is above them.
PLACE_BITS = 33
#: Bytes of a piece, about.
PIECE_BYTES = 1_000_000


def in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `at`, their place in the order of keys (nulls first): sorted ranges, so that even one key's rows lie in many tasks. Not yet written."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())


def part_of(at="at"):
    return F.shiftright(F.col(at), PLACE_BITS).cast("int")


def joined_sha256(pieces: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, sha256) of pieces (keys, at, piece binary), which are joined in the order of at. A digest needs its bytes one after another, so a key's pieces go to
    one task, but they pass through it one at a time and are few: tasks before have joined rows to pieces of PIECE_BYTES."""
    keep = [f for f in pieces.schema.fields if f.name in keys]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for *key, piece in zip(*(batch.column(c).to_pylist() for c in [*keys, "piece"]), strict=True):
                if state is None or key != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(piece)
            if done:
                yield rows_of(done)
        if state is not None:
            yield rows_of([(*now, state.hexdigest())])

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == len(keys) else pa.int64()) for i, x in enumerate(zip(*done, strict=True))], [*keys, "sha256"])

    dealt = pieces.repartition(*keys).sortWithinPartitions(*keys, "at").select(*keys, "piece")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted(keep, key=lambda f: keys.index(f.name)))
    return materialize(dealt.mapInArrow(digest, f"{out}, sha256 string"), name)
