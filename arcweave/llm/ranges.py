"""Dealing rows to ranges of doc_id, in ascending order, for work that follows the ids' order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(docs: DataFrame, bytes_per_range: int) -> list[int]:
    """Ascending ids that start new ranges of about bytes_per_range of text; one number for each range."""
    n, size = docs.select(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = max(1, -(-(size or 0) // bytes_per_range))
    if not n or ranges == 1:
        return []
    marks = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges))).first()[0]
    return sorted(set(marks or []))


def range_of(doc_id: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below doc_id by a binary search, 0 for a null id."""
    if not cuts:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps(cuts)), "array<long>")
    strides = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))
    return F.aggregate(strides, F.lit(0), lambda found, stride: F.when(F.get(array, found + stride - 1) <= doc_id, found + stride).otherwise(found))


def by_ranges(docs: DataFrame, bytes_per_range: int) -> DataFrame:
    """docs with range_id, each range a partition of its own, sorted by doc_id and text."""
    cuts = cut_points(docs, bytes_per_range)
    dealt = docs.withColumn("range_id", range_of(F.col("doc_id"), cuts))
    return dealt.repartitionById(len(cuts) + 1, "range_id").sortWithinPartitions("doc_id", "text")
