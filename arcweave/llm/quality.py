"""Quality rules with robust multivariate outliers (operator 4).

Base rules count words, symbols, repeated lines and repeated 8-word windows. Documents that pass them become vectors of log
ratios, and each language and source gets a minimum-covariance-determinant estimate of its centre and covariance, whatever its size.
Three deterministic starts (medians with median deviations, means with the covariance, medians with the correlation of tanh scores) take two
concentration steps each: the documents of least Mahalanobis distance (a share `support`) are estimated from again. The start of least
determinant goes on until its determinant falls no more. A document is rejected where its distance to its group's estimate passes the
chi-square quantile.

Estimates of few documents are drawn towards their language's, and those of a language towards fixed spreads, with the weight of
DRAWN documents; a group of any size so has its own. A ridge keeps features that are constant in a group (often zero symbols) from making
small deviations look large.

A step is one aggregation over all documents: sums of the vectors by group and by the log distance (32 bins to an octave), with
map-side combining, so a group's size never meets one task; the cut at the share `support` is exact to a bin whatever the order of rows.
Estimates go to the documents by broadcast up to MOST_BROADCAST_GROUPS groups, and beyond it by a join in which groups of many
documents are broadcast.

Null texts have no words and fail the base rules; null languages or sources form groups of their own; repeated rows stay; an
empty table gives no rows; other columns are ignored or carried along as they are.
"""

from __future__ import annotations

import math
import warnings
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import join_counted, materialize, read_table, text_or_empty

SYMBOLS = str.maketrans("", "", "#*$%&|<>")
UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LEAST_WORDS, WINDOW_WORDS, REPEAT_PERCENT = 20, 8, 30
#: Added to the variance of each feature, in the order of features().
RIDGE = (0.01, 0.25, 0.25, 0.25, 0.5, 0.25)
DIM = len(RIDGE)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_shouts", "n_echoes")


def repeated_words(words: list[bytes], size: int = WINDOW_WORDS) -> int:
    """Words in windows of `size` (a power of two) that occur twice or more, the first included."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    width = 1
    while width < size:  # numbers of windows of twice the width from pairs of numbers
        pairs = ids[:-width] * (n + 1) + ids[width:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
        width *= 2
    starts = np.flatnonzero(counts[ids] > 1)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + size, -1)
    return int((np.cumsum(covered) > 0).sum())


def counts_of(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at the six ASCII white-space characters
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    joined = b"".join(words)
    chars = len(joined) if text.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.translate(UPPER))
    return (n, chars, len(text) - len(text.translate(SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), upper, text.count("!") + text.count("?"), sum(map(eq, words, words[1:])))


def with_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, lang, source, the counts of text, and the carried columns."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts_of(x) for x in texts], columns=list(COUNTS))

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", *carry, count(text_or_empty()).alias("counts"))
    return counted.select("doc_id", "lang", "source", *carry, "counts.*")


def features() -> list[Column]:
    per = lambda a, b: F.log1p(F.lit(100.0) * F.col(a) / F.col(b))
    return [F.log(F.col("word_chars") / F.col("n_words")), per("n_symbols", "n_words"), per("n_upper", "word_chars"), per("n_shouts", "n_words"), per("n_repeat_words", "n_words"), per("n_echoes", "n_words")]


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_quantile(p: float, dim: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(dim / 2, mid / 2) < p else (low, mid)
    return low


PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]


#: Documents that the prior of an estimate's covariance and of its centre counts as.
DRAWN, DRAWN_CENTRE = 50.0, 5.0
#: Spreads that languages of few documents are drawn towards, in the order of features().
PRIOR = (0.01, 0.25, 0.25, 0.25, 0.5, 0.25)
MOST_BROADCAST_GROUPS = 50_000
_LIST = T.ArrayType(T.DoubleType())
ESTIMATE = T.StructType([T.StructField("mean", _LIST), T.StructField("covariance", _LIST), T.StructField("precision", _LIST), T.StructField("log_det", T.DoubleType())])


def _full(values: np.ndarray) -> np.ndarray:
    m = np.zeros((DIM, DIM))
    for (i, j), v in zip(PAIRS, values, strict=True):
        m[i, j] = m[j, i] = v
    return m


def estimate_of(n: float, mean: np.ndarray, covariance: np.ndarray, prior_mean: np.ndarray | None, prior: np.ndarray) -> tuple:
    """An estimate (mean, covariance, precision, log_det) from n documents, drawn towards the prior."""
    s, p = _full(covariance), _full(prior)
    if prior_mean is not None:
        apart = mean - prior_mean
        s = s + np.outer(apart, apart) * DRAWN_CENTRE / (n + DRAWN_CENTRE)
        mean = (n * mean + DRAWN_CENTRE * prior_mean) / (n + DRAWN_CENTRE)
    s = (n * s + DRAWN * p) / (n + DRAWN)
    ridged = s + np.diag(RIDGE)
    precision = np.linalg.inv(ridged)
    return mean.tolist(), [float(s[i, j]) for i, j in PAIRS], [float(precision[i, j]) for i, j in PAIRS], float(np.linalg.slogdet(ridged)[1])


@F.pandas_udf(ESTIMATE)
def estimated(n: pd.Series, mean: pd.Series, covariance: pd.Series, prior_mean: pd.Series, prior: pd.Series) -> pd.DataFrame:
    rows = [estimate_of(*x) for x in zip(n, mean, covariance, prior_mean, prior, strict=True)]
    return pd.DataFrame(rows, columns=["mean", "covariance", "precision", "log_det"])


def _distance() -> Column:
    d = [F.col(f"f{i}") - F.get("mean", F.lit(i)) for i in range(DIM)]
    terms = [F.get("precision", F.lit(k)) * d[i] * d[j] * (1 if i == j else 2) for k, (i, j) in enumerate(PAIRS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def with_estimates(vectors: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """vectors with each estimate of their group; now has the number n of a group's vectors. few: there are MOST_BROADCAST_GROUPS at most."""
    return vectors.join(F.broadcast(now.drop("n")), "grp") if few else join_counted(vectors, now, "grp")


def drawn(sums: DataFrame) -> DataFrame:
    """(grp, n, start, e: estimate) of (grp, lang_grp, start, n, m, mean, covariance), where m documents of n have the mean and covariance."""
    fixed = F.array(*(F.lit(PRIOR[i] if i == j else 0.0) for i, j in PAIRS))
    of_lang = sums.filter("grp = lang_grp").withColumn("e", estimated("m", "mean", "covariance", F.lit(None).cast("array<double>"), fixed))
    prior = of_lang.select(F.col("grp").alias("lang_grp"), "start", F.col("e.mean").alias("p"), F.col("e.covariance").alias("q"))
    own = sums.filter("grp <> lang_grp").join(prior, ["lang_grp", "start"]).withColumn("e", estimated("m", "mean", "covariance", "p", "q"))
    return of_lang.select("grp", "start", "n", "e").union(own.select("grp", "start", "n", "e"))


def starts(vectors: DataFrame) -> tuple[DataFrame, bool]:
    """Sums for drawn() of three starts for each group of vectors (grp, lang_grp, f0..), and whether there are few groups."""
    f, dims = [F.col(f"f{i}") for i in range(DIM)], range(DIM)
    key = ["grp", "lang_grp"]
    middle = vectors.groupBy(*key).agg(F.array(*(F.percentile_approx(x, F.lit(0.5), F.lit(1000)) for x in f)).alias("mid"), F.count(F.lit(1)).alias("n"))
    middle = materialize(middle, "medians")
    few = middle.count() <= MOST_BROADCAST_GROUPS
    off = [F.abs(f[i] - F.get("mid", F.lit(i))) for i in dims]
    spread = with_estimates(vectors.drop("lang_grp"), middle, few).groupBy(*key, "mid").agg(F.array(*(1.4826 * F.percentile_approx(x, F.lit(0.5), F.lit(1000)) for x in off)).alias("mad"), F.count(F.lit(1)).alias("n"))
    spread = materialize(spread, "spreads")
    score = [F.tanh((f[i] - F.get("mid", F.lit(i))) / (F.get("mad", F.lit(i)) + F.lit(0.1))) for i in dims]
    both = with_estimates(vectors.drop("lang_grp"), spread, few).groupBy(*key, "mid", "mad").agg(
        F.count(F.lit(1)).alias("n"), F.array(*(F.avg(x) for x in f)).alias("mean"), F.array(*(F.covar_pop(f[i], f[j]) for i, j in PAIRS)).alias("classic"), *(F.covar_pop(score[i], score[j]).alias(f"r{i}{j}") for i, j in PAIRS)
    )
    mad = [F.get("mad", F.lit(i)) for i in dims]
    plain = F.array(*(mad[i] * mad[i] if i == j else F.lit(0.0) for i, j in PAIRS))
    like = lambda i, j: F.coalesce(F.try_divide(F.col(f"r{i}{j}"), F.sqrt(F.col(f"r{i}{i}") * F.col(f"r{j}{j}"))), F.lit(0.0))  # noqa: E731  constant scores have none
    scores = F.array(*(mad[i] * mad[i] if i == j else like(i, j) * mad[i] * mad[j] for i, j in PAIRS))
    entry = lambda k, mean, covariance: F.struct(F.lit(k).alias("start"), mean.alias("mean"), covariance.alias("covariance"))
    return both.select(*key, "n", F.col("n").alias("m"), F.inline(F.array(entry(0, F.col("mid"), plain), entry(1, F.col("mean"), F.col("classic")), entry(2, F.col("mid"), scores)))), few


def concentrated(vectors: DataFrame, now: DataFrame, support: float, few: bool) -> DataFrame:
    """One concentration step: sums for drawn() of each group's nearest documents, for each of its estimates (grp, start, n, e)."""
    factor = gamma_p(DIM / 2 + 1, chi_square_quantile(support, DIM) / 2) / support
    placed = with_estimates(vectors, now.select("grp", "start", "n", "e.mean", "e.precision"), few)
    bins = placed.withColumn("bin", F.floor(32 * F.log2(_distance() + 1e-9))).groupBy("grp", "lang_grp", "start", "bin").agg(
        F.count(F.lit(1)).alias("k"), *(F.sum(f"f{i}").alias(f"s{i}") for i in range(DIM)), *(F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"c{i}{j}") for i, j in PAIRS)
    )
    up_to, whole = Window.partitionBy("grp", "start").orderBy("bin"), Window.partitionBy("grp", "start")
    near = bins.withColumn("below", F.sum("k").over(up_to) - F.col("k")).withColumn("n", F.sum("k").over(whole)).filter(F.col("below") < F.lit(support) * F.col("n"))
    sums = near.groupBy("grp", "lang_grp", "start", "n").agg(F.sum("k").alias("m"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(DIM)), *(F.sum(f"c{i}{j}").alias(f"c{i}{j}") for i, j in PAIRS))
    mean = [F.col(f"s{i}") / F.col("m") for i in range(DIM)]
    covariance = [(F.col(f"c{i}{j}") / F.col("m") - mean[i] * mean[j]) / F.lit(factor) for i, j in PAIRS]
    return materialize(sums.select("grp", "lang_grp", "start", "n", "m", F.array(*mean).alias("mean"), F.array(*covariance).alias("covariance")), "concentrated")


def estimates(vectors: DataFrame, support: float, most_steps: int, close: float = 1e-2) -> tuple[DataFrame, bool]:
    """(grp, n, e: estimate) of each group of vectors (grp, lang_grp, f0..), at the least determinant, and whether there are few groups. Steps end when
    no group's log determinant falls by `close`; a warning says so where most_steps don't do."""
    sums, few = starts(vectors)
    now = materialize(drawn(materialize(sums, "starts")), "estimates")
    for _ in range(2):
        now = materialize(drawn(concentrated(vectors, now, support, few)), "estimates")
    least = Window.partitionBy("grp").orderBy("e.log_det", "start")  # three at most
    now = materialize(now.withColumn("place", F.row_number().over(least)).filter("place = 1").select("grp", F.lit(0).alias("start"), "n", "e"), "estimates")
    for _ in range(most_steps):
        found = drawn(concentrated(vectors, now, support, few)).join(now.select("grp", F.col("e").alias("before")), "grp")
        fell = F.col("before.log_det") - F.col("e.log_det")
        found = materialize(found.select("grp", "start", "n", F.when(fell < 0, F.col("before")).otherwise(F.col("e")).alias("e"), fell.alias("fell")), "estimates")
        now = found.drop("fell")
        if (fallen := found.agg(F.max("fell")).first()[0] or 0) < close:
            break
    else:
        warnings.warn(f"after {most_steps} steps the log determinant of some group still falls by {fallen:.3g}", stacklevel=2)
    return now, few


def judge(docs: DataFrame, support: float = 0.75, most_steps: int = 10, tail: float = 1e-6, carry: list[str] | None = None) -> DataFrame:
    """Counts and verdicts of each (doc_id, text, lang, source), with the carried columns; `distance` is null for documents that fail the base rules."""
    carry = carry or []
    rows = materialize(with_counts(docs, carry), "counts")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    fit = rows.filter("not base_failed").withColumn("grp", F.to_json(F.array("lang", "source"))).withColumn("lang_grp", F.to_json(F.array("lang")))
    f = [x.alias(f"f{i}") for i, x in enumerate(features())]
    vectors = fit.select("lang_grp", F.explode(F.array("lang_grp", "grp")).alias("grp"), *f)
    fitted, few = estimates(materialize(vectors, "vectors"), support, most_steps)
    judged = with_estimates(fit.select(*rows.columns, "grp", *f), fitted.select("grp", "n", "e.mean", "e.precision"), few)
    kept = _distance() <= F.lit(chi_square_quantile(1 - tail, DIM))
    columns = ["doc_id", *COUNTS[:5], "base_failed"]
    passed = judged.select(*columns, kept.alias("kept"), _distance().alias("distance"), "lang", "source", *carry)
    return passed.unionByName(rows.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), "lang", "source", *carry))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    return judge(read_table(spark, sf_dir, "documents")).drop("lang", "source")
