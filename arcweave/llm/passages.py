"""Passages that repeat across documents, by collinear chaining (operator 5).

Seeds are hashes of k words; winnowing keeps the least hash of each `window` in a row, so any run of k + window - 1 equal words
shares a seed. Each seed's first holder (least doc_id) stands for all its holders: a document is matched with it and not with every
other holder, so a passage that a thousand documents share costs a thousand matches. A document's matches with one first holder
are chained in both texts' order, with a cost for gaps, by a Fenwick tree for prefix maxima. From each chain's seeds the words of
both texts are aligned in both directions, over edits of up to `resync` words; what has at least `least_words` equal words, and
`identity` of the longer side equal, is a repeated passage of the later document. The first holder keeps it.

The first holder of a seed may lack the passage, or hold a stray phrase before it. So where matched words stay without a passage, runs of
LEAST_WORDS words and of two and three seeds in a row are matched again, each with its own first holder and place: an exact passage meets a
document that has it whole, whatever documents hold its pieces.

Of a document's chains those are tried first that hold a match outside of the spans of longer ones; the others follow where an accepted
passage doesn't cover all their matches, so no chain is left out but for passages that are found already.

Only documents with enough close matches have their texts moved, and of the first holders only the parts that chains point to. A document
is aligned in one task with matches bounded by its own length.

Null doc_ids and null or short texts have no passages; repeated rows of one doc_id are one document here, so they are not matched with
each other; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_counted, materialize, read_table, slices
from .shingles import words_of

K, WINDOW = 8, 12
#: Three matched seeds at this distance in words: less can't be a passage of LEAST_WORDS words.
CLOSE, LEAST_WORDS, IDENTITY = 64, 50, 0.8
#: Hashes of runs that are sent to every task up to this number (32 MB) and joined by shuffle beyond it.
MOST_BROADCAST_RUNS = 4_000_000
#: Words that a first holder's part reaches over its chain, and the grid on which parts begin and end.
MARGIN, GRID = 128, 64
#: Ids whose texts are wanted are broadcast up to this number (16 MB) and joined by shuffle beyond it.
MOST_BROADCAST_IDS = 2_000_000


def joined(values: np.ndarray, places: range | list[int]) -> np.ndarray:
    """One hash for each place of values: of the values at `places` after it, in order."""
    n = len(values) - places[-1]
    out = np.zeros(n, np.uint64)
    for at in places:
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[at : at + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def seed_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of all runs of K words, from one hash a word."""
    return joined(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), range(K))


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the seeds; of equal hashes in a row only the first is one."""
    n = len(hashes)
    if n <= window:
        return np.array([int(hashes.argmin())])
    at = np.unique(np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(axis=1) + np.arange(n - window + 1))
    return at[(at == 0) | (hashes[at] != hashes[at - 1])]


def seeds(docs: DataFrame) -> DataFrame:
    """(seed, doc_id, pos, first): pos counts words; first: the seed's first place in the document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found: list[list[np.ndarray]] = [[], [], [], []]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                words = words_of(text)
                if len(words) < K:
                    continue
                hashes = seed_hashes(words)
                at = winnow(hashes)
                own = hashes[at].view(np.int64)
                first = np.zeros(len(at), bool)
                first[np.unique(own, return_index=True)[1]] = True
                for x, y in zip(found, (own, np.full(len(at), doc_id), at, first), strict=True):
                    x.append(y)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], ["seed", "doc_id", "pos", "first"])

    return docs.filter("doc_id is not null").mapInArrow(scan, "seed long, doc_id long, pos int, first boolean")


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, matches: array of (other, other_pos, pos)) of documents with seeds that an earlier one holds."""
    found = materialize(seeds(docs), "seeds")
    holders = found.groupBy("seed").agg(F.min(F.when(F.col("first"), F.struct("doc_id", "pos"))).alias("holder"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    holders = holders.filter("holder.doc_id < last").select("seed", F.col("holder.doc_id").alias("other"), F.col("holder.pos").alias("other_pos"), "n")
    pairs = join_counted(found.drop("first"), materialize(holders, "holders"), "seed").filter("doc_id <> other")
    return pairs.groupBy("doc_id").agg(F.collect_list(F.struct("other", "other_pos", "pos")).alias("matches"))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are in a sorted list."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def runs(words: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, pos, words, whole, seed) of all runs of LEAST_WORDS words, and of two and three seeds in a row (not whole: words between may differ).
    seed: one that every document with the run holds; without a seed among the sorted `wanted` ones there are no runs."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, int, int, bool, np.uint64))
    if len(words) < K + 1:
        return none
    hashes, n, found = seed_hashes(words), len(words) - LEAST_WORDS + 1, []
    at = winnow(hashes)
    own = mixed = hashes[at]
    if wanted is not None and not among(own, wanted).any():
        return none
    if n > 0:
        least = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).min(axis=1)[:n]
        found.append((joined(hashes, [*range(0, LEAST_WORDS - K, K), LEAST_WORDS - K]), np.arange(n), np.full(n, LEAST_WORDS), np.ones(n, bool), least))
    for m in (1, 2):
        mixed = mixed[: len(own) - m] * np.uint64(0x9E3779B97F4A7C15) ^ own[m:]
        found.append((mixed, at[: len(mixed)], at[m:] - at[: len(mixed)] + K, np.zeros(len(mixed), bool), own[: len(mixed)]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def open_runs(words: list[bytes], matched: list[int], spans: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, pos, shift, seed) of the runs that an earlier document may have and no passage covers; shift leads to a word outside of passages. In
    equal words every window has a matched seed, so runs with a wider gap between matched places are left out."""
    hashes, pos, size, whole, seed = runs(words)
    n = len(words)
    close, covered = np.zeros(n + 2, int), np.zeros(n + 1, bool)
    at = np.array(matched)
    np.add.at(close, np.maximum(0, at - WINDOW + 1), 1)
    np.add.at(close, np.minimum(n + 1, at + WINDOW), -1)
    far = np.concatenate([[0], np.cumsum(np.cumsum(close) <= 0)])
    for x in spans:
        covered[x["start_word"] : x["end_word"]] = True
    covered[n] = False
    after = np.minimum.accumulate(np.where(covered, n, np.arange(n + 1))[::-1])[::-1]
    shift = np.where(whole, after[pos] - pos, np.where(covered[pos], size - K, 0))
    ok = (far[pos + size - K + 1] == far[pos]) & (shift < size) & ~covered[np.minimum(pos + shift, n)]
    return hashes[ok], pos[ok], shift[ok], seed[ok]


class FirstHolders:
    """The least doc_id and its first place for each of the sorted `wanted` runs that a task's documents hold: a run leaves the task once, however many
    documents share it. Memory is bounded by the number of wanted runs."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        self.held, self.doc, self.pos = np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int32)

    def add(self, doc_id: int, own: np.ndarray, pos: np.ndarray) -> None:
        ok = among(own, self.wanted)
        at, pos = np.searchsorted(self.wanted, own[ok]), pos[ok]
        better = ~self.held[at] | (doc_id < self.doc[at])
        at, pos = at[better], pos[better]
        at, first = np.unique(at[order := np.argsort(pos, kind="stable")], return_index=True)
        self.held[at], self.doc[at], self.pos[at] = True, doc_id, pos[order][first]

    def parts(self, rows: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(run, doc_id, pos) in parts of `rows` rows."""
        found = np.flatnonzero(self.held)
        for start in range(0, len(found), rows):
            at = found[start : start + rows]
            yield self.wanted[at].view(np.int64), self.doc[at], self.pos[at]


def run_matches(docs: DataFrame, matched: DataFrame, passages: DataFrame) -> DataFrame:
    """As matches, of the runs in documents (doc_id, places) with matched places that the passages don't cover."""
    spans = passages.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    asking = docs.join(matched.join(spans, "doc_id", "left"), "doc_id").select("doc_id", "text", "places", F.coalesce("spans", F.array().cast("array<struct<start_word:int,end_word:int>>")).alias("spans"))
    names, types = ["run", "doc_id", "pos", "shift", "seed"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            for doc_id, places, spans, text in zip(part.column("doc_id").to_pylist(), part.column("places").to_pylist(), part.column("spans").to_pylist(), texts, strict=True):
                own, pos, shift, seed = open_runs(words_of(text), places, spans)
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((own.view(np.int64), np.full(len(own), doc_id), pos, shift, seed.view(np.int64)), types, strict=True)], names)

    asked = materialize(asking.mapInArrow(ask, "run long, doc_id long, pos int, shift int, seed long"), "asked-runs")
    wanted = materialize(asked.select("run", "seed").distinct(), "runs")
    few = wanted.count() <= MOST_BROADCAST_RUNS
    known = docs.sparkSession.sparkContext.broadcast([np.unique(wanted.select(x).toArrow()[x].to_numpy().view(np.uint64)) for x in ("run", "seed")]) if few else None

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = None if known is None else FirstHolders(known.value[0])
        for part, texts in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                own, pos = runs(words_of(text), None if known is None else known.value[1])[:2]
                if firsts is not None:
                    firsts.add(doc_id, own, pos)
                elif len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((own.view(np.int64), np.full(len(own), doc_id), pos), types[:3], strict=True)], names[:3])
        for columns in firsts.parts() if firsts is not None else ():
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types[:3], strict=True)], names[:3])

    held = docs.filter("doc_id is not null").mapInArrow(hold, "run long, doc_id long, pos int")
    held = held if few else held.join(wanted.select("run"), "run", "left_semi")
    first = held.groupBy("run").agg(F.min(F.struct("doc_id", "pos")).alias("first")).select("run", F.col("first.doc_id").alias("other"), F.col("first.pos").alias("other_pos"))
    pairs = asked.join(first, "run").filter("other < doc_id").select("doc_id", "other", (F.col("other_pos") + F.col("shift")).alias("other_pos"), (F.col("pos") + F.col("shift")).alias("pos"))
    return pairs.groupBy("doc_id").agg(F.collect_set(F.struct("other", "other_pos", "pos")).alias("matches"))


def chains(own: list[tuple[int, int]], gap_cost: float = 0.02) -> list[list[tuple[int, int]]]:
    """Disjoint chains of (other_pos, pos), both rising, best first. A match counts 1 and a step its words in both texts times gap_cost."""
    own = sorted(set(own))
    ranks = sorted({b for _, b in own})
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ranks) + 1)
    score, before = [0.0] * len(own), [-1] * len(own)
    start = 0
    while start < len(own):  # matches of one other_pos can't follow each other: they are asked for first, then put in
        end = start
        while end < len(own) and own[end][0] == own[start][0]:
            a, b = own[end]
            i, best = bisect_left(ranks, b), (-1e18, -1)
            while i > 0:
                best = max(best, tree[i])
                i -= i & -i
            gain = best[0] - gap_cost * (a + b)
            score[end], before[end] = (1 + gain, best[1]) if gain > 0 else (1.0, -1)
            end += 1
        for x in range(start, end):
            a, b = own[x]
            i, value = bisect_left(ranks, b) + 1, (score[x] + gap_cost * (a + b), x)
            while i <= len(ranks):
                tree[i] = max(tree[i], value)
                i += i & -i
        start = end
    used, out = [False] * len(own), []
    for x in sorted(range(len(own)), key=lambda x: -score[x]):
        chain = []
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(own[x])
            x = before[x]
        if chain:
            out.append(chain[::-1])
    return out


def walk(a: list[bytes], b: list[bytes], i: int, j: int, step: int, resync: int = 16, needed: int = 3) -> tuple[int, int, int]:
    """From a[i], b[j] on in direction step: the places behind the last equal words, and the number of equal words. At a difference the least
    number of words is skipped after which `needed` words are equal again."""
    n, m, same = len(a), len(b), 0
    end = (i, j)
    while 0 <= i < n and 0 <= j < m:
        if a[i] == b[j]:
            i, j, same = i + step, j + step, same + 1
            end = (i, j)
            continue
        for skip in range(1, 2 * resync + 1):
            found = next(
                ((x, skip - x) for x in range(max(0, skip - resync), min(skip, resync) + 1) if all(0 <= i + step * (x + q) < n and 0 <= j + step * (skip - x + q) < m and a[i + step * (x + q)] == b[j + step * (skip - x + q)] for q in range(needed))),
                None,
            )
            if found:
                i, j = i + step * found[0], j + step * found[1]
                break
        else:
            break
    return *end, same


def align(words: list[bytes], other: list[bytes], offset: int, chain: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, equal words) around the chain's matches; other is the part from word `offset` on."""
    out, reached = [], {16: -1, 0: -1}
    for a, b in chain:
        a -= offset
        if b < min(reached.values()) or not (0 <= a < len(other) and b < len(words)) or other[a] != words[b]:
            continue
        for resync in reached:  # with 0 equal words alone, where the edits around them are too many
            if b < reached[resync]:
                continue
            a1, b1, ahead = walk(other, words, a, b, 1, resync)
            a0, b0, behind = walk(other, words, a - 1, b - 1, -1, resync)
            reached[resync] = b1
            if (same := ahead + behind) >= LEAST_WORDS and same >= IDENTITY * max(a1 - a0 - 1, b1 - b0 - 1):
                out.append((b0 + 1, b1, a0 + 1 + offset, a1 + offset, same))
                reached = dict.fromkeys(reached, b1)
                break
    return out


CHAINS = "doc_id long, chains array<struct<other:long,low:int,high:int,leads:boolean,pairs:array<struct<a:int,b:int>>>>"


def find_chains(found: DataFrame, close: int = 3) -> DataFrame:
    """Each document's chains of the matches that are `close` together, with themselves, with the part of `other` that a chain needs. leads: the chain has
    matches outside of the spans of those with more matches."""
    shape = pa.list_(pa.struct([("other", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("leads", pa.bool_()), ("pairs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), batch.column("matches").to_pylist(), strict=True):
                own.sort(key=lambda m: m["pos"])
                at = np.array([m["pos"] for m in own])
                near = np.searchsorted(at, at + CLOSE, "right") - np.searchsorted(at, at - CLOSE, "left") >= close
                by_other = defaultdict(list)
                for m, ok in zip(own, near, strict=True):
                    if ok:
                        by_other[m["other"]].append((m["other_pos"], m["pos"]))
                if not by_other:
                    continue
                found = sorted(((other, c) for other, pairs in by_other.items() for c in chains(pairs)), key=lambda x: (-len(x[1]), x[0], x[1]))
                covered, rows = np.zeros(int(at[-1]) + 1, bool), []
                for other, c in found:
                    leads = not all(covered[b] for _, b in c)
                    if leads:
                        covered[c[0][1] : c[-1][1] + K] = True
                    rows.append({"other": other, "low": max(0, c[0][0] - MARGIN) // GRID * GRID, "high": -(-(c[-1][0] + K + MARGIN) // GRID) * GRID, "leads": leads, "pairs": [{"a": a, "b": b} for a, b in c]})
                ids.append(doc_id)
                out.append(rows)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, shape)], ["doc_id", "chains"])

    return found.mapInArrow(chain, CHAINS)


PASSAGES = "doc_id long, start_word int, end_word int, n_words int, other_doc_id long, other_start_word int, other_end_word int, equal_words int"


def repeated_passages(docs: DataFrame, distinct_ids: bool = False) -> DataFrame:
    """Passages of each document (doc_id, text) that an earlier one (by doc_id) has, with their places in words. distinct_ids: no id comes twice."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not distinct_ids and docs.groupBy("doc_id").count().filter("count > 1").limit(1).count():  # repeated rows of an id count as one document
        docs = docs.groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    matched = materialize(matches(docs), "matches")
    linked = materialize(find_chains(matched), "chains")
    one = lambda df: df.select("doc_id", F.explode("own").alias("c")).select("doc_id", "c.other", "c.low", "c.high", "c.pairs")
    first = materialize(align_chains(docs, materialize(one(linked.select("doc_id", F.filter("chains", lambda c: c["leads"]).alias("own"))), "leading")), "passages")
    spans = first.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    rest = linked.select("doc_id", F.filter("chains", lambda c: ~c["leads"]).alias("others")).filter(F.size("others") > 0).join(spans, "doc_id", "left")
    outside = lambda p: ~F.exists("spans", lambda s: (p["b"] >= s["start_word"]) & (p["b"] < s["end_word"]))
    left = F.when(F.col("spans").isNull(), F.col("others")).otherwise(F.filter("others", lambda c: F.exists(c["pairs"], outside)))
    rest = materialize(one(rest.select("doc_id", left.alias("own"))), "other-chains")
    found = materialize(first.union(align_chains(docs, rest)), "passages")
    again = run_matches(docs, matched.select("doc_id", F.col("matches.pos").alias("places")), found)
    return found.union(align_chains(docs, materialize(one(find_chains(again, 1).withColumnRenamed("chains", "own")), "run-chains")))


def only(ids: DataFrame) -> DataFrame:
    """Distinct ids, written, and marked for broadcast where there are few."""
    ids = materialize(ids.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids


def align_chains(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """Passages that the texts confirm for chains (doc_id, other, low, high, pairs)."""
    parts = materialize(linked.groupBy("other").agg(F.collect_set(F.struct("low", "high")).alias("parts")), "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows = []
            for doc_id, wanted, text in zip(part.column("doc_id").to_pylist(), part.column("parts").to_pylist(), texts, strict=True):
                words = words_of(text)
                rows += [(doc_id, p["low"], p["high"], b" ".join(words[p["low"] : p["high"]]).decode("utf-8", "surrogatepass")) for p in wanted]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["other", "low", "high", "words"])

    holders = docs.join(only(parts.select(F.col("other").alias("doc_id"))), "doc_id", "left_semi")
    pieces = holders.join(parts.withColumnRenamed("other", "doc_id"), "doc_id").select("doc_id", "text", "parts").mapInArrow(cut, "other long, low int, high int, words string")
    with_words = linked.join(pieces, ["other", "low", "high"]).groupBy("doc_id").agg(F.collect_list(F.struct("other", "low", "pairs", "words")).alias("chains"))
    later = docs.join(only(linked.select("doc_id")), "doc_id", "left_semi")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            rows = []
            for doc_id, own, text in zip(part.column("doc_id").to_pylist(), part.column("chains").to_pylist(), texts, strict=True):
                words = words_of(text)
                covered = np.zeros(len(words) + 1, bool)
                for c in sorted(own, key=lambda c: (-len(c["pairs"]), c["other"], [(p["a"], p["b"]) for p in c["pairs"]])):
                    pairs = [(p["a"], p["b"]) for p in c["pairs"]]
                    if all(covered[min(b, len(words))] for _, b in pairs):
                        continue  # the passage is found already
                    for start, end, a0, a1, same in align(words, c["words"].encode("utf-8", "surrogatepass").split(), c["low"], pairs):
                        if not covered[start:end].all():
                            covered[start:end] = True
                            rows.append((doc_id, start, end, end - start, c["other"], a0, a1, same))
            if rows:
                types = [pa.int64(), *[pa.int32()] * 3, pa.int64(), *[pa.int32()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in PASSAGES.split(", ")])

    return later.join(with_words, "doc_id").mapInArrow(find, PASSAGES)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs without the words of the passages; a document that has no word left goes. Other columns stay as they are, whatever their names."""
    spans = passages.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("cut_spans"))
    columns, docs = docs.columns, docs.select("doc_id", "text", F.struct(*docs.columns).alias("own_columns"))
    marked = docs.join(spans, "doc_id", "left")

    def without(text: str, spans: list[dict]) -> str | None:
        places = [m.span() for m in WORD.finditer(text)]
        out, at, done = [], 0, 0
        for s, e in sorted((x["start_word"], min(x["end_word"], len(places))) for x in spans):
            s = max(s, done)
            if s < e:
                out.append(text[at : places[s][0]])
                at, done = places[e - 1][1], e
        out.append(text[at:])
        return kept if WORD.search(kept := "".join(out)) else None

    @F.pandas_udf(T.StringType())
    def cut(text, spans):  # noqa: ANN001, ANN202
        return text.combine(spans, lambda t, s: without(t, s))

    edited = F.when(F.col("cut_spans").isNotNull(), cut(F.coalesce("text", F.lit("")), F.coalesce("cut_spans", F.array().cast("array<struct<start_word:int,end_word:int>>")))).otherwise(F.col("text"))
    return marked.withColumn("text", edited).filter("cut_spans is null or text is not null").select(*(F.col("text") if c == "text" else F.col("own_columns").getField(c).alias(c) for c in columns))


def op5_passages(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeated_passages(read_table(spark, sf_dir, "documents"))
