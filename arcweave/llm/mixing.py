"""Mixing documents to target domain weights with soft membership (operator 2, DataFrame functions alone).

A naive Bayes classifier from the label table gives each document posteriors over the domains good, poor and toxic. It is fitted on at
most `most_labelled` labelled documents (those with the least hashed ids) and has the `most_words` words that tell the domains
apart best; a document is judged by which of these words it has and lacks. Rates r >= 0 (and <= most_rate) then minimise the squared
difference between expected domain tokens sum(r * tokens * posterior) and their targets, by projected gradient steps from r = 1. A rate is
the projection of 1 - posterior * moved, where `moved` adds up the steps, so a step is three numbers. A step follows the gradient, scaled by
the inverse curvature of the documents that no bound holds; several lengths of it are tried in the one aggregation that also gives the next
gradient and curvature, and the best is taken. Steps end when the targets are met to `close` of all tokens, or when none comes nearer, which
means that no rates in the bounds meet them; then the rates are those that come nearest, and a warning says by how much they miss.

Null texts have no tokens and lack all words; null labels and labels without a document are left out (an unlabelled corpus gives every
domain the same prior); repeated rows are rows of their own; an empty table gives no rows; other columns are ignored or carried along.
"""

from __future__ import annotations

import json
import warnings
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table

DOMAINS = ("good", "poor", "toxic")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x20.,;:!?\"()]+"), lambda w: w != "")


def classifier(docs: DataFrame, labels: DataFrame, most_labelled: int, most_words: int, least_documents: int = 5) -> tuple[list[float], DataFrame]:
    """Each domain's log posterior for a document with none of the words, and (word, l0..): what the word's presence adds to it."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    known = labels.select("doc_id", domain.alias("domain")).filter("domain is not null").dropDuplicates(["doc_id"])
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    known = materialize(known, "labelled")
    counts = dict(known.groupBy("domain").count().collect())
    sizes = [counts.get(k, 0) for k in range(len(DOMAINS))]
    share = [(n + 1) / (sum(sizes) + len(sizes)) for n in sizes]
    seen = docs.join(F.broadcast(known), "doc_id").select("domain", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    have = seen.groupBy("word").agg(*(F.count_if(F.col("domain") == k).alias(f"n{k}") for k in range(len(DOMAINS))), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_documents)
    expected = [F.col("n") * n / max(1, sum(sizes)) for n in sizes]
    chi = reduce(add, (F.pow(F.col(f"n{k}") - e, F.lit(2)) / F.greatest(e, F.lit(0.5)) for k, e in enumerate(expected)))
    rate = [(F.col(f"n{k}") + 0.5) / (n + 1.0) for k, n in enumerate(sizes)]
    adds = [F.log(r / (1 - r)).alias(f"l{k}") for k, r in enumerate(rate)]
    absent = [F.log1p(-r).alias(f"a{k}") for k, r in enumerate(rate)]
    chosen = materialize(have.filter(chi > 15).orderBy(F.desc(chi), "word").limit(most_words).select("word", *adds, *absent), "classifier")
    none = chosen.agg(*(F.coalesce(F.sum(f"a{k}"), F.lit(0.0)) for k in range(len(DOMAINS)))).first()
    return [float(np.log(x) + y) for x, y in zip(share, none, strict=True)], chosen.select("word", *(f"l{k}" for k in range(len(DOMAINS))))


def posteriors(docs: DataFrame, labels: DataFrame, carry: list[str], most_labelled: int = 20_000, most_words: int = 1000) -> DataFrame:
    """docs' doc_id, n_tokens (words), p0.. for the domains and the carried columns. A word's weights are found by a binary search in the list
    of most_words at most, row by row, so that no document meets another."""
    prior, weights = classifier(docs, labels, most_labelled, most_words)
    known = sorted(tuple(r) for r in weights.collect())  # most_words at most
    own, dims = words(F.col("text")), range(len(DOMAINS))
    logit = [F.lit(p) for p in prior]
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, own.alias("all_words"))
    if known:
        names = F.from_json(F.lit(json.dumps([k[0] for k in known])), "array<string>")
        table = F.from_json(F.lit(json.dumps([k[1:] for k in known])), "array<array<double>>")
        strides = F.array(*(F.lit(1 << k) for k in range(len(known).bit_length() - 1, -1, -1)))
        place = lambda w: F.aggregate(strides, F.lit(0), lambda at, s: F.when(F.get(names, at + s - 1) <= w, at + s).otherwise(at)) - 1
        listed = F.array_distinct(F.filter("all_words", lambda w: w.isin([k[0] for k in known])))
        added = F.transform(listed, lambda w: F.get(table, place(w)))
        held = held.withColumn("sums", F.aggregate(added, F.array(*(F.lit(0.0) for _ in dims)), lambda total, x: F.zip_with(total, x, lambda u, v: u + v)))
        logit = [F.get("sums", F.lit(k)) + p for k, p in enumerate(prior)]
    logits = materialize(held.select("doc_id", *carry, F.size("all_words").cast("long").alias("n_tokens"), *(x.alias(f"s{k}") for k, x in enumerate(logit))), "logits")
    best = F.greatest(*(f"s{k}" for k in dims))
    total = reduce(add, (F.exp(F.col(f"s{k}") - best) for k in dims))
    return logits.select("doc_id", *carry, "n_tokens", *((F.exp(F.col(f"s{k}") - best) / total).alias(f"p{k}") for k in dims))


#: Lengths of a step that are tried at once, by the curvature of the free documents and of all.
LENGTHS, MORE_LENGTHS = (0.0, 0.02, 0.1, 0.3, 0.6, 1.0, 1.5), (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)


def fit_rates(rows: DataFrame, targets: list[float] | None, multiples: list[float] | None, most_rate: float, close: float, most_steps: int, nearer_by: float = 1e-3) -> Column:
    """A column over rows (n_tokens, p0..): the rate. targets: shares of all tokens; multiples: of what each domain has at rate 1."""
    dims = range(len(DOMAINS))
    p, t = [F.col(f"p{k}") for k in dims], F.col("n_tokens")
    pairs = [(i, j) for i in dims for j in dims if i <= j]

    def measured(points: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The domains' tokens and the curvature at each point, from one aggregation. Points are a constant array, so that Spark compiles it once."""
        at = F.from_json(F.lit(json.dumps([list(map(float, x)) for x in points])), "array<array<double>>")
        free = F.lit(1.0) - reduce(add, (x * F.get("point", F.lit(k)) for k, x in enumerate(p)))
        placed = rows.select("n_tokens", *p, F.posexplode(at).alias("at", "point")).select("at", t.alias("t"), *p, free.alias("free"))
        rate = F.least(F.greatest("free", F.lit(0.0)), F.lit(float(most_rate)))
        inside = F.when((F.col("free") >= 0) & (F.col("free") <= float(most_rate)), F.col("t")).otherwise(0)
        sums = [F.sum(rate * F.col("t") * x) for x in p] + [F.sum(inside * p[i] * p[j]) for i, j in pairs]
        found = {r[0]: np.array(r[1:], float) for r in placed.groupBy("at").agg(*sums).collect()}  # a row for each point
        out = []
        for k in range(len(points)):
            v = found.get(k, np.zeros(len(sums)))
            gram = np.zeros((len(p), len(p)))
            for (i, j), x in zip(pairs, v[len(p) :], strict=True):
                gram[i, j] = gram[j, i] = x
            out.append((v[: len(p)], gram))
        return out

    moved = np.zeros(len(p))
    now, gram = measured([moved])[0]
    every, tokens = gram, max(1.0, now.sum())
    goal = np.array(targets) * now.sum() / sum(targets) if targets else np.array(multiples) * now
    for _ in range(most_steps):
        gap = now - goal
        if np.abs(gap).max() <= close * tokens or not every.any():
            break
        step, slow = (np.linalg.pinv(x, rcond=1e-12, hermitian=True) @ gap for x in (gram + 1e-6 * every, every))
        points = [moved + x * step for x in LENGTHS] + [moved + x * slow for x in MORE_LENGTHS]
        tried = measured(points)
        best = min(range(len(points)), key=lambda k: float(((tried[k][0] - goal) ** 2).sum()))
        nearer = ((tried[best][0] - goal) ** 2).sum() < (1 - nearer_by) * (gap**2).sum()
        moved, (now, gram) = points[best], tried[best]
        if not nearer:
            break
    if (miss := np.abs(now - goal).max() / tokens) > 100 * close:
        warnings.warn(f"the rates that come nearest miss a target by {miss:.2%} of all tokens", stacklevel=2)
    free = F.lit(1.0) - reduce(add, (x * float(m) for x, m in zip(p, moved, strict=True)))
    return F.least(F.greatest(free, F.lit(0.0)), F.lit(float(most_rate)))


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, multiples: dict[str, float] | None = None, most_rate: float = 4.0, close: float = 1e-6, most_steps: int = 40, nearest: bool = False, carry: list[str] | None = None
) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate and copies, and the carried columns. copies has the rate as its mean, by the hash of doc_id; nearest: it is the nearest number."""
    carry = carry or []
    rows = posteriors(docs, labels, carry)
    listed = lambda x: [float(x[d]) for d in DOMAINS] if x else None
    fitted = rows.withColumn("rate", fit_rates(rows, listed(targets), listed(multiples), most_rate, close, most_steps))
    point = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    copies = F.floor(F.col("rate") + (F.lit(0.5) if nearest else point))
    return fitted.select("doc_id", "n_tokens", *(F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", copies.cast("int").alias("copies"), *carry)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates of all documents for a mix of good, poor and very few toxic tokens."""
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), targets={"good": 0.8, "poor": 0.18, "toxic": 0.02})
