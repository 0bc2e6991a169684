"""Scoring by a subword lattice (operator 7).

The pieces of an existing vocabulary are the arcs of a lattice over each word (with the vocabulary's word mark before it), and a
text's probability is the sum over all its segmentations of the product of their pieces' probabilities, times that of an end
piece. Pieces never cross a word's start, so the sum over a text is the product of the words' sums; each is a forward recursion in log
space. A character that is no piece has one arc, its UTF-8 bytes' pieces. Words of like length are scored together; a word over LONG
characters is scored for itself, in memory that grows with its length alone.

Piece probabilities start from the vocabulary's scores (it ranks its pieces; weight 1 / (10 - score)) and are estimated again
from the training documents' words by expectation maximisation: expected uses of each piece over all segmentations, with the first
weights as a prior of `prior` uses.

lattice_score is that marginal alone. For score, a word's probability is (c + V * lattice) / (N + V), with its training count c, all training
tokens N and the number of distinct ones V (Witten-Bell): a whole word that was seen is one more segmentation, weighted by how often it
was, and the lattice has the share of new words. Without training documents both are the lattice. No file of unigram scores is at hand: the
vocabulary is that of a BPE model, whose scores are ranks.

Word counts, and what each word adds to the two scores, are tables that grow with the corpus. Texts are scored where they lie with
the `hot` most frequent words, a bounded list; all other words go through a join by word and a sum by document. Both ways are exact.

Null texts are empty and consist of the end alone. A null doc_id is a training document. Repeated rows each give a row; an empty table
gives none, and without training documents every count is zero.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table, slices
from .shingles import words_of
from .tokens import tokenizer_path

MARK = "▁"
FOLDS, HELD_OUT_FOLD = 7, 2
LONG = 200
LOG10 = math.log(10)


def vocabulary(model_path: str) -> tuple[list[str], list[float]]:
    """Pieces and first weights; the last piece is the end, the 256 before it are the bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) and model.get_score(i) > -1e8]
    weights = [1 / (10 - model.get_score(i)) for i in ids]
    least = min(weights)
    return [model.id_to_piece(i) for i in ids] + [f"<0x{b:02X}>" for b in range(256)] + ["</s>"], [*weights, *[least] * 256, max(weights)]


class Lattice:
    def __init__(self, pieces: list[str]):
        self.n, self.bytes = len(pieces), len(pieces) - 257
        self.index = {p: i for i, p in enumerate(pieces[: self.bytes])}
        self.longest = max(map(len, self.index))
        # a trie of the pieces as arrays: keys hold a state and the code of a character, to the state that follows, found its piece or -1
        self.code = np.zeros(0x110000, np.int32)
        letters = sorted(set().union(*self.index))
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.codes = len(letters) + 1
        state = {"": 0} | {p: k for k, p in enumerate(sorted({p[:k] for p in self.index for k in range(1, len(p) + 1)}), 1)}
        keys = np.array([state[p[:-1]] * self.codes + int(self.code[ord(p[-1])]) for p in state if p], np.int64)
        order = np.argsort(keys)
        self.keys, self.to, self.found = keys[order], (order + 1).astype(np.int32), np.array([self.index.get(p, -1) for p in state], np.int32)

    def _groups(self, words: list[str]) -> Iterator[tuple[int, list[int], list[tuple[int, int]]]]:
        by_length = defaultdict(list)
        for k, w in enumerate(words):
            if len(w) <= LONG:
                by_length[len(w)].append(k)
        for size, own in by_length.items():
            spans = [(i, j) for j in range(1, size + 1) for i in range(max(0, j - self.longest), j)]
            step = max(1, 1_000_000 // len(spans))
            for at in range(0, len(own), step):
                yield size, own[at : at + step], spans

    def _ids(self, group: list[str], size: int, spans: list[tuple[int, int]]) -> np.ndarray:
        """The piece of each span (row) of words of one size (column), -1 where there is none."""
        out = np.full((len(spans), len(group)), -1, np.int64)
        text = self.code[np.array(group, f"<U{size}").view(np.uint32).reshape(len(group), size)]
        row_of = np.full((size, size + 1), -1)
        row_of[tuple(np.array(spans).T)] = np.arange(len(spans))
        word, start = map(np.ravel, np.indices(text.shape, np.int32))
        state = np.zeros(len(word), np.int32)
        for end in range(1, min(size, self.longest) + 1):
            fits = start + end <= size
            word, start, state = word[fits], start[fits], state[fits]
            key = state * np.int64(self.codes) + text[word, start + end - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            word, start, state = word[on], start[on], self.to[at[on]]
            piece = self.found[state]
            hit = piece >= 0
            out[row_of[start[hit], start[hit] + end], word[hit]] = piece[hit]
        return out

    def _long(self, word: str, log_p: np.ndarray, weight: float | None, used: np.ndarray | None) -> float:
        """As run, for one word: forward probabilities by position, and with a weight the expected uses on the way back."""
        get, letters = self.index.get, {c: [self.bytes + b for b in c.encode("utf-8", "surrogatepass")] for c in set(word) if c not in self.index}
        spelt = {c: float(log_p[x].sum()) for c, x in letters.items()}

        def arcs(j: int) -> list[tuple[int, int, float]]:
            """(start, piece or -1, log probability) of the arcs that end at j."""
            found = [(i, p, log_p[p]) for i in range(max(0, j - self.longest), j) if (p := get(word[i:j], -1)) >= 0]
            return found if word[j - 1] not in spelt else [*found, (j - 1, -1, spelt[word[j - 1]])]

        ahead = np.full(len(word) + 1, -np.inf)
        ahead[0] = 0
        for j in range(1, len(word) + 1):
            own = arcs(j)
            ahead[j] = np.logaddexp.reduce([ahead[i] + x for i, _, x in own])
        if used is not None:
            behind = np.full(len(word) + 1, -np.inf)
            behind[-1] = 0
            for j in range(len(word), 0, -1):
                for i, piece, x in arcs(j):
                    share = weight * math.exp(ahead[i] + x + behind[j] - ahead[-1])
                    for at in [piece] if piece >= 0 else letters[word[i]]:
                        used[at] += share
                    behind[i] = np.logaddexp(behind[i], x + behind[j])
        return float(ahead[-1])

    def run(self, words: list[str], log_p: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word (marked), and with weights the expected uses of each piece."""
        out, used = np.zeros(len(words)), None if weights is None else np.zeros(self.n)
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self._long(w, log_p, None if weights is None else weights[k], used)
        for size, own, spans in self._groups(words):
            group = [words[k] for k in own]
            ids = self._ids(group, size, spans)
            arcs = np.where(ids >= 0, log_p[ids], -np.inf)
            spelt = []
            for s, (i, j) in enumerate(spans):
                if j - i == 1:
                    for k in np.flatnonzero(ids[s] < 0):
                        letters = [self.bytes + b for b in group[k][i].encode("utf-8", "surrogatepass")]
                        arcs[s, k] = log_p[letters].sum()
                        spelt.append((s, k, letters))
            ahead = np.full((size + 1, len(group)), -np.inf)
            ahead[0] = 0
            at = 0
            for j in range(1, size + 1):
                first = max(0, j - self.longest)
                ahead[j] = np.logaddexp.reduce(ahead[first:j] + arcs[at : at + j - first], axis=0)
                at += j - first
            out[own] = ahead[size]
            if used is None:
                continue
            behind = np.full((size + 1, len(group)), -np.inf)
            behind[size] = 0
            for s in range(len(spans) - 1, -1, -1):
                i, j = spans[s]
                behind[i] = np.logaddexp(behind[i], arcs[s] + behind[j])
            starts, ends = np.array(spans).T
            share = np.exp(ahead[starts] + arcs + behind[ends] - ahead[size]) * weights[own]
            used += np.bincount(np.where(ids >= 0, ids, self.n).ravel(), share.ravel(), self.n + 1)[: self.n]
            for s, k, letters in spelt:
                np.add.at(used, letters, share[s, k])
        return out, used


def count_words(docs: DataFrame, most_held: int = 300_000) -> DataFrame:
    """(word, c, n) of (text, held_out): occurrences in training documents and in all; each task counts before it sends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, others = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = [*(trained.keys() | others.keys())]
            c = [trained[w] for w in words]
            columns = [pa.array([w.decode() for w in words], pa.string()), pa.array(c, pa.int64()), pa.array([a + others[w] for a, w in zip(c, words, strict=True)], pa.int64())]
            trained.clear()
            others.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "c", "n"])

        for part, texts in slices(batches):
            for held, text in zip(part.column("held_out").to_pylist(), texts, strict=True):
                (others if held else trained).update(words_of(text))
            if len(trained) + len(others) > most_held:
                yield flush()
        yield flush()

    return docs.select("text", "held_out").mapInArrow(count, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def estimate(words: DataFrame, pieces: list[str], weights: list[float], ends: int, rounds: int, prior: float) -> np.ndarray:
    """Log probabilities of the pieces after some rounds of expectation maximisation over (word, c); the driver holds one number for each piece."""
    sc = words.sparkSession.sparkContext
    first = np.array(weights) / sum(weights)
    log_p, shared = np.log(first), sc.broadcast(pieces)
    for _ in range(rounds):
        now = log_p

        def expect(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(shared.value)
            total = np.zeros(lattice.n)
            for batch in batches:
                total += lattice.run([MARK + w for w in batch.column("word").to_pylist()], now, batch.column("c").to_numpy().astype(float))[1]
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit])], ["piece", "uses"])

        used = np.zeros(len(pieces))
        for piece, uses in words.filter("c > 0").select("word", "c").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses")).collect():
            used[piece] = uses
        used[-1] = ends
        p = used + prior * first
        log_p = np.log(p / p.sum())
    return log_p


def with_word_arc(lattice: np.ndarray, c: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """log10 of (c + distinct * 10 ** lattice) / (total + distinct)."""
    if not distinct:
        return lattice
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(c.astype(float)), math.log(distinct) + lattice * LOG10) / LOG10 - math.log10(total + distinct)


SCORED = "k1 long, k2 long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lattice double, score double, rare array<string>"


def score_documents(docs: DataFrame, model_path: str, rounds: int = 1, prior: float = 1000.0, hot: int = 150_000) -> DataFrame:
    spark = docs.sparkSession
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.alias("held_out"))
    counts = materialize(count_words(docs), "words")
    ends = docs.filter("not held_out").count()
    in_words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, distinct = in_words + ends, kinds + (ends > 0)
    pieces, weights = vocabulary(model_path)
    log_p = estimate(counts, pieces, weights, ends, rounds, prior)
    shared = spark.sparkContext.broadcast(pieces)
    base = lambda c: F.log10((c + 1) / F.lit(float(total + distinct + 1)))

    def add_lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            alone = lattice.run([MARK + w for w in batch.column("word").to_pylist()], log_p)[0] / LOG10
            found = with_word_arc(alone, batch.column("c").to_numpy(), total, distinct)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "c", "n")), pa.array(alone), pa.array(found)], ["word", "c", "n", "lattice", "score"])

    words = materialize(counts.mapInArrow(add_lattice, "word string, c long, n long, lattice double, score double"), "scored-words")
    # the frequent words are those of as many whole octaves' eighths of counts as fit into the list
    octave = F.floor(8 * F.log2("n"))
    sizes = sorted(words.filter("n > 0").groupBy(octave.alias("octave")).count().collect(), reverse=True)  # a few hundred rows
    fits = [at for (at, _), held in zip(sizes, accumulate(x for _, x in sizes), strict=True) if held <= hot]
    top = words.filter((F.col("n") > 0) & (octave >= F.lit(fits[-1] if fits else sizes[0][0] + 1 if sizes else 0))).select("word", "c", "lattice", "score").toArrow()
    index = {w.encode(): i for i, w in enumerate(top["word"].to_pylist())}
    table = spark.sparkContext.broadcast((index, *(top[x].to_numpy() for x in ("c", "lattice", "score"))))
    del top, index
    end_lattice = float(log_p[-1]) / LOG10
    norm, end_base, end_score, end_known = total + distinct + 1, math.log10((ends + 1) / (total + distinct + 1)), float(with_word_arc(log_p[-1:] / LOG10, np.array([ends]), total, distinct)[0]), int(ends > 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, c, alone, score = table.value
        known, base_of, get = np.append(c > 0, False).astype(np.int64), np.append(np.log10((c + 1) / norm), 0.0), index.get
        lattice_of, score_of, nowhere = np.append(alone, 0.0), np.append(score, 0.0), len(c)
        k1, k2 = random.SystemRandom().getrandbits(62), 0  # names each row of the table that is written from this
        for part, texts in slices(batches):
            rows = []
            for doc_id, held, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts, strict=True):
                words = words_of(text)
                at = np.fromiter((get(w, nowhere) for w in words), np.int64, len(words))
                rare = [words[i].decode() for i in np.flatnonzero(at == nowhere)]
                rows.append((k1, k2, doc_id, held, len(words) + 1, int(known[at].sum()) + end_known, float(base_of[at].sum()) + end_base, float(lattice_of[at].sum()) + end_lattice, float(score_of[at].sum()) + end_score, rare))
                k2 += 1
            types = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SCORED.split(", ")])

    scanned = materialize(docs.mapInArrow(scan, SCORED), "scanned")
    rare = scanned.select("k1", "k2", F.explode("rare").alias("word")).join(words.select("word", "c", "lattice", "score"), "word")
    sums = rare.groupBy("k1", "k2").agg(F.count_if(F.col("c") > 0).alias("more_known"), F.sum(base(F.col("c"))).alias("more_base"), F.sum("lattice").alias("more_lattice"), F.sum("score").alias("more_score"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    out = scanned.drop("rare").join(sums, ["k1", "k2"], "left")
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score"), plus("lattice", "more_lattice").alias("lattice_score"))


def op7_lattice_score(spark, sf_dir: str) -> DataFrame:
    """Base and lattice scores of all documents."""
    return score_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
