"""Hierarchical multi-length packing of token pieces (operator 1).

Documents become windows of the longest size and one tail. Tails are routed to tiers, each tail to the smallest that holds it. From the longest
tier to the shortest, each tier's tails open windows of the tier's own size; the gap is filled with the longest tails of shorter
tiers that fit, and what is left of it is closed with a piece that is cut off a tail. So each window is full, but for the last one.
Sequences are dealt to step groups of the same number of tokens.

A task encodes its documents where they lie and packs them in blocks of bounded size; tails that a block leaves unpacked go to the next
one. Nothing is shuffled, so no key or mass of equal rows meets one task, and a task leaves one padded window at most.

Equal rows are packed each for itself, null texts are empty (the end id alone), null doc_ids stay null, an empty table gives no rows and
other columns are ignored. A text is encoded whole, whatever its length; a long one is cut into windows at once.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices
from .tokens import encoder, tokenizer_path

TIERS = (128, 256, 512, 1024)
#: Windows of the longest size that a step group has the tokens of.
GROUP_WINDOWS = 16
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier long, step_group long"


class TailPool:
    """Lengths from 1 to `longest`, each with the keys of the tails that have it."""

    def __init__(self, longest: int):
        self.longest, self.free, self.have = longest, defaultdict(list), 0

    def put(self, length: int, key: int) -> None:
        self.free[length].append(key)
        self.have |= 1 << length

    def largest(self, room: int) -> int:
        """The greatest length up to room, 0 if there is none."""
        return max(0, (self.have & ((1 << (room + 1)) - 1)).bit_length() - 1)

    def least(self) -> int:
        return (self.have & -self.have).bit_length() - 1

    def take(self, length: int) -> int:
        key = self.free[length].pop()
        if not self.free[length]:
            self.have &= ~(1 << length)
        return key


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (position in lengths, start in that tail, length). All hold a tier's number of tokens but the last, which may hold fewer."""
    pool, windows = TailPool(tiers[-1]), []
    cut_at = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -i):
        pool.put(lengths[i], i)
    for tier, shorter in zip(tiers[::-1], [*tiers[-2::-1], 0], strict=True):
        while pool.largest(tier) > shorter:
            window, room = [], tier
            while room and pool.have:
                n = pool.largest(room)
                whole = n > 0
                n = n or pool.least()  # every tail is longer than the gap: the shortest is cut
                i = pool.take(n)
                own = n if whole else room
                window.append((i, cut_at[i], own))
                if not whole:
                    cut_at[i] += own
                    pool.put(n - own, i)
                room -= own
            windows.append(window)
    return windows


class Packer:
    """Takes documents' ids, gives rows of PACKED."""

    def __init__(self, first_id: int, tiers: tuple[int, ...]):
        self.next_id, self.tiers = first_id, tiers
        self.groups, self.next_group = {}, first_id  # tier: (group, windows that it still takes)
        self.tails: list[tuple[int | None, int, int, np.ndarray]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        window, n = self.tiers[-1], len(ids)
        for at in range(0, n - window + 1, window):
            self._sequence([(doc_id, at, n, ids[at : at + window])])
        if n % window:
            at = n - n % window
            self.tails.append((doc_id, at, n, ids[at:].copy()))

    def _sequence(self, pieces: list[tuple[int | None, int, int, np.ndarray]]) -> None:
        used = sum(len(p[3]) for p in pieces)
        tier = used if used in self.tiers else self.tiers[-1]
        group, room = self.groups.get(tier, (0, 0))
        if not room:  # each tier has groups of its own, all of the same number of tokens
            group, room = self.next_group, GROUP_WINDOWS * self.tiers[-1] // tier
            self.next_group += 1
        self.groups[tier] = group, room - 1
        offset = 0
        for doc_id, start, n, ids in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_id, offset, used, tier, group))
            offset += len(ids)
        self.next_id += 1

    def pack(self, last: bool) -> None:
        """Packs the tails; all but the last time a window that isn't full stays as tails."""
        held, self.tails = self.tails, []
        for window in pack_lengths([len(t[3]) for t in held], self.tiers):
            pieces = [(held[i][0], held[i][1] + at, held[i][2], held[i][3][at : at + n]) for i, at, n in window]
            if last or sum(n for _, _, n in window) in self.tiers:
                self._sequence(pieces)
            else:
                self.tails += pieces

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], [c.split()[0] for c in PACKED.split(", ")])


def pack_documents(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = 0, keep_space: bool = True, tails_in_block: int = 8192) -> DataFrame:
    """One row for each piece of (doc_id, text): its place in the document and in its sequence, with the unsigned crc32 of its ids, the
    sequence's tokens and tier, and its step group. Ids of sequences and groups have the task's number in their upper half."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, keep_space).encode, np.array([end_id], np.uint32)
        packer = Packer(TaskContext.get().partitionId() << 32, tiers)
        for part, texts in slices(batches):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                packer.add(doc_id, np.concatenate([ids, end]))
                if len(packer.tails) >= tails_in_block:
                    packer.pack(False)
            if packer.rows:
                yield packer.batch()
        packer.pack(True)
        if packer.rows:
            yield packer.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(pack, PACKED)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
