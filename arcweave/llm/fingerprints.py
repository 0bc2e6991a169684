"""Canonical exact digests of documents (operator 10).

A text's canonical form is NFKC, case-folded, with runs of white space as one space and none at its ends; its digest is 128-bit
XXH3. Documents with equal digests are compared byte by byte: for each digest that two documents share, the least and the greatest
canonical text must be the same (an aggregate that Spark combines before it shuffles, so thousands of copies cost a row in each
task). Where they are not, which only a hash collision gives, fingerprints carry a piece of SHA-256 behind the digest. The
likeness of two fingerprints is 1 where the canonical texts are the same and else 0.

The edited text needs the next document by doc_id, so rows are dealt to ranges of doc_id, with the first row of a range also
sent to the range before it. Null texts are empty; null doc_ids come first; equal doc_ids are ordered by text; an empty table
gives no rows, and of a single row the next is the row itself. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, read_table, slices, text_or_empty
from .ranges import cut_points, range_of

LEAST_ID = -(2**63)
#: Ids of documents that share a digest are broadcast up to this number (16 MB), and joined by shuffle beyond it.
MOST_BROADCAST_IDS = 2_000_000


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def with_next(docs: DataFrame, bytes_per_range: int) -> DataFrame:
    """(doc_id, text, range_id, later): each range sorted, with the next range's first rows behind it as later = 1."""
    key = F.coalesce("doc_id", F.lit(LEAST_ID))
    cuts = cut_points(docs, bytes_per_range)
    ranged = docs.select("doc_id", text_or_empty().alias("text"), key.alias("key"), range_of(F.col("doc_id"), cuts).alias("own"))
    firsts = sorted(ranged.groupBy("own").agg(F.min("key")).collect())  # a row for each range
    first_key, before, last = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1), None
    for own, least in firsts:
        first_key[own], before[own], last = least, last, own
    if firsts:
        before[firsts[0][0]] = last
    array = lambda x, kind: F.from_json(F.lit(json.dumps(x)), f"array<{kind}>")
    own = F.struct(F.col("own").alias("range_id"), F.lit(0).alias("later"))
    earlier = F.struct(F.get(array(before, "int"), F.col("own")).alias("range_id"), F.lit(1).alias("later"))
    places = F.when(F.get(array(first_key, "long"), F.col("own")) == F.col("key"), F.array(own, earlier)).otherwise(F.array(own))
    dealt = ranged.select("doc_id", "text", "key", F.explode(places).alias("at")).select("doc_id", "text", "key", "at.*")
    return dealt.repartitionById(len(cuts) + 1, "range_id").sortWithinPartitions("later", "key", "text").drop("key")


#: A document's edited text, digests and likenesses, in one pass over sorted ranges.
DIGESTS = "doc_id long, n_chars long, edited_sha256 string, digest string, tail string, edited_digest string, edited_tail string, near_edited double, near_next double"


TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in DIGESTS.split(", ")]


def digest_rows(docs: DataFrame, bytes_per_range: int) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc_id: int, text: str, form: str, after: str, after_form: str) -> tuple:
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            own, new = _bytes(form), _bytes(edited_form := canonical(edited))
            print_of = lambda x: (xxhash.xxh3_128_hexdigest(x), hashlib.sha256(x).hexdigest()[:16])
            return (doc_id, len(text), hashlib.sha256(_bytes(edited)).hexdigest(), *print_of(own), *print_of(new), float(form == edited_form), float(form == after_form))

        held = closed = None  # the row that waits for its next one: (range, id, text, canonical text)
        for part, texts in slices(batches):
            out = []
            for doc_id, own, later, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "range_id", "later")), texts, strict=True):
                if later and closed == own:
                    continue
                form = canonical(text)
                if held is not None:
                    out.append(row(*held[1:], text, form))
                held, closed = (None, own) if later else ((own, doc_id, text, form), None)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), TYPES, strict=True)], [c.split()[0] for c in DIGESTS.split(", ")])

    return with_next(docs, bytes_per_range).mapInArrow(digest, DIGESTS)


def fingerprints(docs: DataFrame, bytes_per_range: int = 24_000_000) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(digest_rows(docs, bytes_per_range), "digests")
    shared = materialize(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-digests")
    ids = materialize(join_counted(rows.select("digest", "doc_id"), shared, "digest", "left_semi").select("doc_id").distinct(), "shared-ids")
    ids = F.broadcast(ids) if ids.count() <= MOST_BROADCAST_IDS else ids

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            own = [_bytes(canonical(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(x) for x in own]), pa.array(own, pa.binary())], ["digest", "form"])

    texts = docs.join(ids, "doc_id", "left_semi").select(text_or_empty().alias("text"))
    compared = texts.mapInArrow(forms, "digest string, form binary").groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("greatest"))
    unequal = materialize(compared.filter("least <> greatest").select("digest"), "unequal-digests")
    named = lambda digest, tail, mark: F.when(mark, F.concat_ws("-", digest, tail)).otherwise(F.col(digest))
    own, again, out = F.lit(False), F.lit(False), rows
    if not unequal.isEmpty():  # only where two texts have one digest
        mark = F.broadcast(unequal) if unequal.count() <= MOST_BROADCAST_IDS else unequal
        out = out.join(mark.withColumn("unequal", F.lit(True)), "digest", "left")
        out = out.join(mark.select(F.col("digest").alias("edited_digest"), F.lit(True).alias("edited_unequal")), "edited_digest", "left")
        own, again = F.col("unequal"), F.col("edited_unequal")
    return out.select("doc_id", "n_chars", "edited_sha256", named("digest", "tail", own).alias("fingerprint"), named("edited_digest", "edited_tail", again).alias("edited_fingerprint"), "near_edited", "near_next")


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints(read_table(spark, sf_dir, "documents"))
