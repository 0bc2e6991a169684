"""SimHash near-duplicates by a generalised pigeonhole (operator 8).

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Equal fingerprints are one node. For all
pairs within `most_bits`, the bits are grouped into partitions, bits that go together into one (from the correlations of a bounded
sample of fingerprints), and each partition i gets a threshold t_i with sum(t_i) = most_bits - partitions + 1: by the pigeonhole a
pair within most_bits is within t_i in one partition at least. Thresholds, -1 (partition not probed) included, come from dynamic
programming over estimated candidate counts. Each fingerprint goes under its own value of a partition and probes all values
within t_i; candidates are verified on all bits.

Two fingerprints that share a bucket are only paired there while the bucket is small. Fingerprints of buckets over `most_in_bucket` are dealt anew by
more bits: of six groups of bits a pair within two differs in two at most, so it agrees in all bits of one choice of four. Those whose narrow
buckets are over `most_in_bucket` too go another exact way, linear in their number: a bit flipped at a time, fingerprints within two bits
always share a 1-bit neighbour, and all that share one are within two bits of each other, so each neighbour value links its holders to the least of them.
For an even most_bits of 2r the same holds of neighbours within r bits; most_bits has to be even. No bucket is capped and no
link between different fingerprints is lost; components are those of all links.

Null and empty texts, and any without words, have the fingerprint zero and link like others. Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize, read_table, slices, text_or_empty
from .components import connected_components
from .shingles import shingle_hashes, words_of

BITS = 64
#: Ids whose texts are wanted are broadcast up to this number (16 MB) and joined by shuffle beyond it.
MOST_BROADCAST_IDS = 1_000_000


def _rehashed(hashes: np.ndarray, count: int) -> np.ndarray:
    """count independent hashes of each hash, itself first (64-bit finalisers of evenly spaced offsets)."""
    x = hashes[:, None] + np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = hashes
    return x


def fingerprint_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """64 * count bits, each set where over half of the hashes have it; the first 64 are those of a fingerprint of 64."""
    ones, block = np.zeros(BITS * count, np.int64), max(64, 4096 // count)
    for at in range(0, len(hashes), block):
        own = hashes[at : at + block]
        own = _rehashed(own, count) if count > 1 else np.ascontiguousarray(own)
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8 * count), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint_words(text: str, words_in_shingle: int, count: int, seed: int = 42) -> np.ndarray:
    """The fingerprint of a text's shingles, repeats included."""
    words = words_of(text)
    return fingerprint_of(shingle_hashes(words, words_in_shingle, seed), count) if words else np.zeros(count, np.uint64)


def fingerprint(text: str, words_in_shingle: int, seed: int = 42) -> int:
    return int(fingerprint_words(text, words_in_shingle, 1, seed)[0])


def with_fingerprints(docs: DataFrame, words_in_shingle: int) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            fps = np.array([fingerprint(x, words_in_shingle) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, fp long")


def shingle_set(text: str, words_in_shingle: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = words_of(text)
    return np.unique(shingle_hashes(words, words_in_shingle)) if words else np.empty(0, np.uint64)


def with_set_fingerprints(docs: DataFrame, words_in_shingle: int, count: int) -> DataFrame:
    """(doc_id, digest, words): 128 bits of a hash of the whole set of shingles, and a fingerprint of 64 * count bits, each shingle once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            sets = [shingle_set(x, words_in_shingle) for x in texts]
            words = np.array([fingerprint_of(x, count) for x in sets], np.uint64).reshape(-1, count).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, count), pa.int32()), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), lists], ["doc_id", "digest", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, digest binary, words array<long>")


def correlated_partitions(sample: np.ndarray, partitions: int, width: int | None = None) -> list[list[int]]:
    """Bits in groups of like size (or of the width, some bits are left out then), each grown by the bit that correlates most with those it has."""
    bits = np.unpackbits(sample.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    spread = bits.std(axis=0)
    z = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    like = np.abs(z.T @ z) / max(1, len(sample))
    free, out = list(range(BITS)), []
    for k in range(partitions):
        size = width or len(free) // (partitions - k)
        own = [free.pop(0)]
        while len(own) < size:
            best = max(free, key=lambda b: (like[b, own].sum(), -b))
            free.remove(best)
            own.append(best)
        out.append(sorted(own))
    return out


def thresholds(sample: np.ndarray, parts: list[list[int]], most_bits: int, rows: int, most_each: int | None = None) -> list[int]:
    """For each partition -1..most_each (most_bits if that is not given), with the sum that the pigeonhole asks for, at the least estimated work: probe rows plus candidates,
    the latter from the share of the sample's pairs that lie within the threshold."""
    bits = np.unpackbits(np.ascontiguousarray(sample.astype("<i8")).view(np.uint8).reshape(len(sample), -1), axis=1, bitorder="little")
    shift = np.roll(bits, 1 + len(bits) // 3, axis=0)
    costs = []
    for own in parts:
        apart, probes, row = (bits[:, own] != shift[:, own]).sum(axis=1), 0, [0.0]
        for t in range((most_bits if most_each is None else most_each) + 1):
            probes += _choose(len(own), t)
            share = max(float((apart <= t).mean()) if len(apart) else 0.0, probes / 2 ** len(own))
            row.append(rows * probes + rows * rows * share / 2)
        costs.append(row)
    want, best = most_bits - len(parts) + 1, {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, own in enumerate(row, -1):
                new = (cost + own, [*chosen, t])
                if total + t not in step or new < step[total + t]:
                    step[total + t] = new
        best = step
    return best[want][1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks of all sets of up to `most` of the bits."""
    masks = layer = [(0, 0)]
    for _ in range(most):
        layer = [(m | 1 << bits[i], i + 1) for m, at in layer for i in range(at, len(bits))]
        masks = masks + layer
    return [_signed(m) for m, _ in masks]


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def buckets(fps: DataFrame, most_bits: int, partitions: int, rows: int, sample_rows: int) -> DataFrame:
    """(part, value, own, fp) of all values that the fingerprints probe, own where it holds the value itself. sample_rows bounds what the grouping of bits
    and the estimates are fitted on."""
    share = min(1.0, 4 * sample_rows / max(1, rows))
    sample = np.array([r[0] for r in fps.sample(share, seed=1).limit(sample_rows).collect()] or [0], np.int64)
    parts = correlated_partitions(sample, partitions)
    limits = thresholds(sample, parts, most_bits, rows)
    probed = None
    for i, (own, t) in enumerate(zip(parts, limits, strict=True)):
        if t < 0:
            continue
        mask = F.lit(_signed(sum(1 << b for b in own))).cast("long")
        row = fps.select(F.lit(i).alias("part"), F.col("fp").bitwiseAND(mask).alias("value"), F.lit(True).alias("own"), "fp")
        flips = F.explode(_longs(_flips(own, t)))
        probe = row if t == 0 else row.select("part", "value", "fp", flips.alias("flip")).select("part", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") == 0).alias("own"), "fp")
        probed = probe if probed is None else probed.union(probe)
    return materialize(probed, "probes") if max(limits) > 0 else probed


def shared_buckets(probed: DataFrame) -> DataFrame:
    """(part, value, n) of the buckets of (part, value, own, fp) that can pair: n entries of several fingerprints, one of which holds the value itself.
    Values that are only probed pair none."""
    sizes = probed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("held"), F.min("fp").alias("least"), F.max("fp").alias("greatest"))
    return sizes.filter("held and least < greatest").select("part", "value", "n")


def _paired(probed: DataFrame, most_bits: int, most_in_bucket: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) within most_bits that buckets of up to most_in_bucket bring together, and the fingerprints (fp) of larger ones."""
    sizes = materialize(shared_buckets(probed), "buckets")
    small, large = sizes.filter(F.col("n") <= most_in_bucket), sizes.filter(F.col("n") > most_in_bucket)
    near = probed.filter("own").join(small, ["part", "value"], "left_semi").select("part", "value", F.col("fp").alias("a"))
    other = probed.join(small, ["part", "value"], "left_semi").select("part", "value", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits
    pairs = near.join(other, ["part", "value"]).filter((F.col("a") != F.col("b")) & close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs, materialize(probed.join(large, ["part", "value"], "left_semi").select("fp").distinct(), "crowd")


def narrow_buckets(fps: DataFrame, most_bits: int, sample_rows: int, spare: int = 4) -> DataFrame:
    """(part, value, own, fp): of most_bits + spare groups of bits a pair within most_bits has `spare` without a difference, so each fingerprint goes under its
    bits in each choice of that many groups."""
    sample = np.array([r[0] for r in fps.limit(sample_rows).collect()] or [0], np.int64)
    masks = [_signed(sum(1 << b for own in chosen for b in own)) for chosen in combinations(correlated_partitions(sample, most_bits + spare), spare)]
    entries = F.transform(_longs(masks), lambda m: F.struct(m.alias("part"), F.col("fp").bitwiseAND(m).alias("value")))
    return fps.select("fp", F.inline(entries)).select("part", "value", F.lit(True).alias("own"), "fp")


def links(fps: DataFrame, most_bits: int, partitions: int | None = None, most_in_bucket: int = 24, sample_rows: int = 4096) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (fp) whose components are those of all pairs within most_bits."""
    if most_bits % 2:
        raise ValueError("most_bits has to be even")
    pairs, crowd = _paired(buckets(fps, most_bits, partitions or most_bits + 1, fps.count(), sample_rows), most_bits, most_in_bucket)
    if crowd.isEmpty():
        return pairs.distinct()
    more, crowd = _paired(narrow_buckets(crowd, most_bits, sample_rows), most_bits, most_in_bucket)
    return pairs.union(more).union(star_links(crowd, most_bits)).distinct()


def words_for(rows: int, similarity: float, recall: float) -> tuple[int, int]:
    """(width of a partition in bits, words of a fingerprint). The width is log2 of the number of rows, so that a value of a partition has few
    fingerprints by chance; there are as many partitions as bring pairs of the similarity together with the recall, whatever the width: two
    fingerprints agree in a bit with the probability 1 - angle / pi, where the angle's cosine is that of sets with the Jaccard similarity. Twice
    the rows take about 1.2 times the partitions."""
    width = min(BITS // 2, max(12, int(np.ceil(np.log2(max(2, rows))))))
    agree = (1 - np.arccos(2 * similarity / (1 + similarity)) / np.pi) ** width
    return width, max(2, int(np.ceil(np.log(1 - recall) / np.log1p(-agree) / (BITS // width))))


def wide_buckets(fps: DataFrame, width: int, count: int, rows: int, sample_rows: int = 4096) -> DataFrame:
    """(part, value, own, fp, first) of all values that (fp, words) probe, own where it holds the value itself; fp only names the row. Each word has
    its own partitions, and the thresholds of all of them sum to 0, so all pairs with fewer differing bits than there are partitions come up.
    `first` has the fingerprint's first two words. Each row is read once."""
    share = min(1.0, 4 * sample_rows / max(1, rows))
    sample = np.array([r[0] for r in fps.select("words").sample(share, seed=1).limit(sample_rows).collect()] or [[0] * count], np.int64)
    parts = [[BITS * k + b for b in own] for k in range(count) for own in correlated_partitions(sample[:, k], BITS // width, width)]
    limits = thresholds(sample, parts, len(parts) - 1, max(1, rows), most_each=2)
    probes = lambda i, value, flips: F.transform(flips, lambda m: F.struct(F.lit(i).alias("part"), value.bitwiseXOR(m).alias("value"), (m == 0).alias("own")))
    probed = []
    for i, (own, t) in enumerate(zip(parts, limits, strict=True)):
        if t < 0:
            continue
        bits = [b % BITS for b in own]
        value = F.get("words", F.lit(own[0] // BITS)).bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))).cast("long"))
        flips = F.expr(f"array({','.join(f'{m}L' for m in _flips(bits, t))})")
        probed.append(probes(i, value, flips))
    first = F.struct(*(F.get("words", F.lit(k)).alias(f"w{k}") for k in range(2)))
    return fps.select("fp", first.alias("first"), F.inline(F.flatten(F.array(*probed)))).select("part", "value", "own", "fp", "first")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _near_all(pairs: DataFrame, fps: DataFrame, count: int, most_share: float) -> DataFrame:
    """The pairs (a, b), the lesser first, that differ in most_share of all bits of (fp, words) at most."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wide = pairs.join(fps.toDF("a", "left"), "a").join(fps.toDF("b", "right"), "b")
    total = F.aggregate(F.zip_with("left", "right", _apart), F.lit(0), lambda n, x: n + x)
    return wide.filter(total <= int(BITS * count * most_share)).select("a", "b")


def wide_entries(fps: DataFrame, width: int, count: int) -> DataFrame:
    """(part, value, own, fp, first, least, work) of (fp, words): the entries of buckets that a holder (own) shares with another, with the least holder
    (fp, first) and the number of pairs of a holder and a prober."""
    probed = wide_buckets(fps, width, count, fps.count())
    own = F.when(F.col("own"), F.struct("fp", "first"))
    sizes = probed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.count(own).alias("k"), F.min(own).alias("least")).filter("n > 1 and k > 0")
    sizes = materialize(sizes.select("part", "value", "least", (F.col("n") * F.col("k")).alias("work")), "buckets")
    return materialize(probed.join(sizes, ["part", "value"]), "entries")


def _words_apart(x: str, y: str) -> Column:
    return _apart(F.col(f"{x}.w0"), F.col(f"{y}.w0")) + _apart(F.col(f"{x}.w1"), F.col(f"{y}.w1"))


def _close(x: str, y: str, most_share: float) -> Column:
    """Two words say less than all: somewhat more of their bits may differ before a pair is left out."""
    return _words_apart(x, y) <= int(2 * BITS * (most_share + 0.0625))


def nearest_pairs(entries: DataFrame, most_share: float) -> DataFrame:
    """Pairs (a, b) of each fingerprint b with two of the least holders of its buckets that it is close to: the least and the nearest."""
    found = entries.filter((F.col("fp") != F.col("least.fp")) & _close("first", "least.first", most_share))
    near = F.min(F.struct(_words_apart("first", "least.first").alias("apart"), F.col("least.fp").alias("a")))
    both = found.groupBy(F.col("fp").alias("b")).agg(F.min("least.fp").alias("least"), near.alias("near"))
    return both.select(F.explode(F.array("least", "near.a")).alias("a"), "b")


def with_components(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """The entries with the component of each (parts: node, component)."""
    return entries.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def split_entries(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """The entries of buckets with several components, with the component of each."""
    now = with_components(entries, parts)
    several = now.groupBy("part", "value").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("part", "value")
    return now.join(several, ["part", "value"])


def cross_pairs(entries: DataFrame, most_share: float) -> DataFrame:
    """All pairs (a, b) of a holder and a prober of a bucket that are in different components, close, and not both in the crowd."""
    a = entries.filter("own").select("part", "value", F.col("fp").alias("a"), F.col("first").alias("x"), F.col("component").alias("ca"), F.col("crowd").alias("wa"))
    b = entries.select("part", "value", F.col("fp").alias("b"), F.col("first").alias("y"), F.col("component").alias("cb"), F.col("crowd").alias("wb"))
    return a.join(b, ["part", "value"]).filter((F.col("ca") != F.col("cb")) & ~(F.col("wa") & F.col("wb")) & _close("x", "y", most_share)).select("a", "b")


def _least(x: Column) -> Column:
    return F.ceil(x - F.lit(1e-6))


def prefix_pairs(sets: DataFrame, similarity: float, block: int = 512, last: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of (fp, component, size, shingle), one row for each of the `size` shingles of a set, that take in all of different components
    with the Jaccard similarity. Shingles that one component alone has bring nothing together: they come first in the order of all shingles, the
    others by the number of sets that have them, rare ones first. Alike sets of n and m shingles share s / (1 + s) * (n + m) at least, so the first
    one that they share lies as early in both as leaves room for these; sets whose shingles are mostly their component's own have none so early.
    Holders of a frequent shingle are dealt in blocks.

    A column `after` counts a set's shingles that come after all that have rows; those of them that lie early enough are in last (fp, component, size,
    shingle, left), with what is left of the set from each on."""
    after = F.col("after") if "after" in sets.columns else F.lit(0)
    counts = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("shingle", "n")
    held = sets.join(counts, "shingle").select("fp", "component", "size", "shingle", "n", (F.count(F.lit(1)).over(Window.partitionBy("fp")) + after).alias("shared"))
    held = held.filter(F.col("shared") >= _least(similarity * F.col("size")))
    place = F.row_number().over(Window.partitionBy("fp").orderBy("n", "shingle"))
    # what is left of a set from a shingle on, itself included
    early = held.withColumn("left", F.col("shared") - place + 1).filter(F.col("left") >= _least(similarity * F.col("size")))
    early = early.select("fp", "component", "size", "shingle", "left")
    early = materialize(early if last is None else early.unionByName(last), "prefixes")
    blocks = early.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("shingle", "blocks")
    rows = early.join(blocks, "shingle")
    one = rows.select("shingle", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("at"), F.col("fp").alias("a"), F.col("component").alias("ca"), F.col("size").alias("na"), F.col("left").alias("la"))
    two = rows.select("shingle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), F.col("fp").alias("b"), F.col("component").alias("cb"), F.col("size").alias("nb"), F.col("left").alias("lb"))
    room = F.least("la", "lb") >= _least(similarity / (1 + similarity) * (F.col("na") + F.col("nb")))
    return one.join(two, ["shingle", "at"]).filter((F.col("ca") < F.col("cb")) & room).select("a", "b").distinct()


def frequent_shingles(sets: DataFrame, sample_sets: int = 256, sample_shingles: int = 4096) -> np.ndarray:
    """Shingles of several of a bounded sample of sets (fp, shingles, ascending), the frequent ones last. They only give an order: no result hangs on them."""
    some = sets.select("fp", F.slice("shingles", 1, sample_shingles).alias("shingles")).orderBy(F.xxhash64("fp")).limit(sample_sets)
    counts = some.select(F.explode("shingles").alias("frequent")).groupBy("frequent").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return np.array([r[0] for r in counts.orderBy(F.desc("n"), "frequent").limit(sample_shingles).collect()][::-1], np.int64)


def alike_sets(sets: DataFrame, similarity: float, frequent: np.ndarray) -> DataFrame:
    """The pairs that prefix_pairs has of sets (fp, component, shingles), which are written already. Rare shingles come before the frequent ones, in the order of these. Alike sets
    share one of their first shingles, whatever the order is: so only sets whose first ones are some other component's too, or frequent, get rows for
    all their rare shingles, and a frequent shingle gets one only where it is among a set's first."""
    ranks = np.argsort(frequent)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("shingles")
            starts, values = column.offsets.to_numpy(), column.values.to_numpy()
            sets = [values[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            places = [np.searchsorted(frequent, x, sorter=ranks) for x in sets]
            ids = [ranks[np.minimum(p, len(ranks) - 1)] if len(ranks) else p for p in places]
            often = [frequent[i] == x if len(ranks) else np.zeros(len(x), bool) for i, x in zip(ids, sets, strict=True)]
            rare = [x[~f] for x, f in zip(sets, often, strict=True)]
            last = [frequent[np.sort(i[f])] if len(ranks) else x[:0] for i, f, x in zip(ids, often, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("component"), pa.array([len(x) for x in sets], pa.int32()), pa.array(rare, pa.list_(pa.int64())), pa.array(last, pa.list_(pa.int64()))], ["fp", "component", "size", "rare", "frequent"])

    rows = sets.mapInArrow(split, "fp long, component long, size int, rare array<long>, frequent array<long>")
    rows = materialize(rows.withColumn("first", (F.col("size") - _least(similarity * F.col("size")) + 1).cast("int")).withColumn("after", F.size("frequent")), "split")
    own = ["fp", "component", "size", "after"]
    early = materialize(rows.select(*own, F.explode(F.slice("rare", F.lit(1), F.col("first"))).alias("shingle")), "early")
    shared = early.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("shingle")
    some = early.join(shared, "shingle", "left_semi").select("fp").union(rows.filter(F.size("rare") < F.col("first")).select("fp")).distinct()
    some = materialize(some, "some")
    others = rows.filter(F.size("rare") > F.col("first")).join(some, "fp", "left_semi")
    others = others.select(*own, F.explode(F.slice("rare", F.col("first") + 1, F.size("rare"))).alias("shingle"))
    last = rows.filter(F.size("rare") < F.col("first")).select(*own, F.posexplode(F.slice("frequent", F.lit(1), F.col("first") - F.size("rare"))).alias("at", "shingle"))
    last = last.select("fp", "component", "size", "shingle", (F.col("after") - F.col("at")).alias("left"))
    held = materialize(early.join(some, "fp", "left_semi").union(others), "held")
    return prefix_pairs(held, similarity, last=last)


def settled(parts: DataFrame, more: DataFrame) -> DataFrame:
    """The components (node, component) with the edges more (a, b), which are written already."""
    return parts if more.isEmpty() else connected_components(parts.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))


def sized(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component, size, degree) of parts (node, component): the component's number of nodes, and how many links (a, b) the node has."""
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    degrees = links.select("a").union(links.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "node")
    return parts.join(sizes, "component").join(degrees, "node", "left").select(F.col("node").alias("fp"), "component", "size", F.coalesce("degree", F.lit(0)).alias("degree"))


def head_pairs(entries: DataFrame, nodes: DataFrame, parts: DataFrame, tried: DataFrame, most_share: float, most_in_bucket: int, many: int) -> DataFrame:
    """Pairs (a, b), not tried yet, of each fingerprint b with two heads of its buckets that it is close to and not in one component with: that of the largest component and most links, and
    the nearest. A bucket's head is the holder of the largest component and most links (nodes: fp, component, size, degree); a component has to have `many` nodes, in buckets over
    most_in_bucket three."""
    held = entries.filter("own").join(nodes.filter("size >= 3"), "fp").filter((F.col("size") >= many) | (F.col("work") > most_in_bucket))
    best = F.max_by(F.struct("fp", "first", "component", "size", "degree"), F.struct("size", "degree", -F.col("fp")))
    heads = materialize(held.groupBy("part", "value").agg(best.alias("head")), "heads")
    found = with_components(entries.select("part", "value", "fp", "first"), parts).join(heads, ["part", "value"]).filter((F.col("component") != F.col("head.component")) & _close("first", "head.first", most_share))
    found = found.select(F.col("head.fp").alias("a"), F.col("fp").alias("b"), "head.size", "head.degree", _words_apart("first", "head.first").alias("apart")).join(tried, ["a", "b"], "left_anti")
    both = found.groupBy("b").agg(F.max_by("a", F.struct("size", "degree", -F.col("a"))).alias("most"), F.min(F.struct("apart", "a")).alias("near"))
    return both.select(F.explode(F.array_distinct(F.array("most", "near.a"))).alias("a"), "b")


def around(entries: DataFrame, nodes: DataFrame, parts: DataFrame, most_share: float) -> DataFrame:
    """The nodes (fp), and the fingerprints that share a bucket with a close one of them in another component, one of the two as its holder: one row each, however many they are close to."""
    sided = lambda df, side: with_components(df, parts).select("part", "value", *(F.col(x).alias(f"{side}_{x}") for x in ("fp", "own", "first", "component")))
    plain = entries.select("part", "value", "fp", "own", "first")
    a, b = sided(materialize(plain.join(nodes.select("fp"), "fp", "left_semi"), "inside"), "a"), sided(plain, "b")
    meet = (F.col("a_component") != F.col("b_component")) & (F.col("a_own") | F.col("b_own")) & _close("a_first", "b_first", most_share)
    near = b.join(a, (a["part"] == b["part"]) & (a["value"] == b["value"]) & meet, "left_semi").select(F.col("b_fp").alias("fp")).distinct()
    return nodes.select("fp").union(near).distinct()


def bucket_components(entries: DataFrame, near: Callable[[DataFrame], DataFrame], alike: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], similarity: float, most_share: float, most_in_bucket: int, rounds: int = 4, many: int = 32) -> DataFrame:
    """Components (node, component) of all verified pairs of a holder and a prober of a bucket. near verifies pairs by all bits and texts, alike by texts
    alone. Each fingerprint is held against two others first. Then, in rounds for as long as a tenth of the pairs are links, what is close to a component of `many` nodes or
    crowds in a bucket is held against two heads at most, the nodes with most links (the base of a star of edits has them). What is in or close to a component of
    `many` nodes then, or apart in a bucket of over most_in_bucket pairs, is the crowd: all its pairs are found by their shingles (sets), exact, and without those that
    share a bucket by chance or are somewhat too far apart. All other pairs, with one outside of the crowd, come from the smaller buckets."""
    tried = materialize(nearest_pairs(entries, most_share), "tried")
    links = near(tried)
    parts = connected_components(links)
    tried = tried.union(tried.select("b", "a"))
    for _ in range(rounds):
        held = materialize(head_pairs(entries, materialize(sized(parts, links), "sizes"), parts, tried, most_share, most_in_bucket, many), "tried")
        more = near(held)
        tried, links, parts = tried.union(held).union(held.select("b", "a")), links.union(more), settled(parts, more)
        if more.count() <= 0.1 * held.count():
            break
    nodes = materialize(sized(parts, links), "sizes").filter(F.col("size") >= many)
    small = entries.filter(F.col("work") <= most_in_bucket)
    crowd = split_entries(entries.filter(F.col("work") > most_in_bucket), parts).select("fp")
    crowd = materialize((crowd if nodes.isEmpty() else crowd.union(around(small, nodes, parts, most_share))).distinct(), "crowd")
    flagged = with_components(small, parts).join(crowd.withColumn("crowd", F.lit(True)), "fp", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    parts = settled(parts, near(cross_pairs(flagged, most_share)))
    if crowd.isEmpty():
        return parts
    left = materialize(sets(with_components(crowd, parts).select("fp", "component")), "sets")
    return settled(parts, alike(alike_sets(left, similarity, frequent_shingles(left))))


def star_links(fps: DataFrame, most_bits: int) -> DataFrame:
    """Links of all pairs within most_bits by shared neighbours: two fingerprints within 2r bits share a value within r bits of both,
    and all holders of such a value are within 2r bits of each other."""
    r = most_bits // 2
    flips = lambda k: F.explode(_longs(_flips(list(range(BITS)), k)))
    near = fps.select("fp", flips(r).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = near.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("value", "a")
    return near.join(least, "value").filter("fp > a").select("a", F.col("fp").alias("b"))


def components_of(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (the least doc_id that links reach) of rows (doc_id, fp)."""
    grouped = nodes.join(connected_components(edges), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(grouped.join(ids, "component").join(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fp").select("fp", "component_id", "n"), "components")
    return join_counted(rows, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, words_in_shingle: int = 3, most_bits: int = 2) -> DataFrame:
    """Components of documents (doc_id, text) whose fingerprints differ in most_bits bits at most."""
    rows = materialize(with_fingerprints(docs, words_in_shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return components_of(rows, nodes, links(nodes.select("fp"), most_bits))


def near_duplicates_verified(docs: DataFrame, words_in_shingle: int = 5, similarity: float = 0.8, recall: float = 0.95, most_share: float = 0.22, most_in_bucket: int = 1024) -> DataFrame:
    """(doc_id, component_id) of documents (doc_id, text), whose ids are distinct and not null, in components of those whose sets of shingles have the Jaccard
    similarity: equal sets by the digest of the whole set, others by fingerprints long enough to find pairs at that similarity with the recall
    (closer pairs more often), all of them verified on the texts."""
    width, count = words_for(docs.count(), similarity, recall)
    rows = materialize(with_set_fingerprints(docs, words_in_shingle, count), "fingerprints")
    nodes = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("fp"), F.first("words").alias("words")), "nodes")
    fps = nodes.select("fp", "words")

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        sets: dict[str, np.ndarray] = {}
        out = []
        for x, y in zip(left, right, strict=True):
            if sum(map(len, sets.values())) > 1_000_000:
                sets.clear()
            a, b = (sets[t] if t in sets else sets.setdefault(t, shingle_set(t, words_in_shingle)) for t in (x, y))
            n = len(np.intersect1d(a, b, assume_unique=True))
            out.append(n >= similarity * (len(a) + len(b) - n))
        return pd.Series(out, dtype=bool)

    def texts_of(wanted: DataFrame) -> DataFrame:
        wanted = materialize(wanted, "wanted")
        few = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST_IDS else wanted
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(few, "doc_id")

    def sets(wanted: DataFrame) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in slices(batches):
                found = [np.sort(shingle_set(x, words_in_shingle).view(np.int64)) for x in texts]
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("component"), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(found))).cast(pa.list_(pa.int64()))], ["fp", "component", "shingles"])

        return texts_of(wanted.withColumnRenamed("fp", "doc_id")).select("doc_id", "component", "text").mapInArrow(scan, "fp long, component long, shingles array<long>")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "candidates")
        texts = materialize(texts_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()), "texts")
        with_texts = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b")
        return materialize(with_texts.filter(alike("left", "right")).select("a", "b"), "links")

    entries = wide_entries(fps, width, count)
    found = bucket_components(entries, lambda pairs: verified(_near_all(pairs, fps, count, most_share)), verified, sets, similarity, most_share, most_in_bucket)
    parts = nodes.join(found, F.col("fp") == F.col("node"), "left").select("digest", F.coalesce("component", "fp").alias("component_id"))
    named = materialize(parts.join(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digest"), "components")
    return join_counted(rows.select("digest", "doc_id"), named, "digest").select("doc_id", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
